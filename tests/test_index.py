import os
import time

import pytest
from symdex import __main__ as cli
from symdex.api import Engine
from symdex.sources.store import Manifest, Store, StoreLocked, StoreMoved
from symdex.streaming import ingest

FILES = {
    "src/app.py": '"""Web app."""\nimport os\nLIMIT = 10\n@app.route("/login")\ndef login():\n    """Log the user in."""\n    return 1\n',
    "web/a.js": "export async function loadUsers() {\n return 1\n}\nclass Foo {}\n",
    "README.md": "\n".join(f"Line {i} about running database users" for i in range(120)),
    "node_modules/x/a.js": "function hidden() {}\n",
    "gen.py": "# do not edit\nx = 1\n",
}


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def rows(engine):
    return sorted(map(str, engine.chunks().drop("id", "file_mtime").collect()))


def test_life_of_an_index(spark, tmp_path):
    root = tmp_path / "proj"
    for name, text in FILES.items():
        write(root, name, text)
    e = Engine(spark, str(root))
    assert not e.status()["indexed"] and e.search_code("user").count() == 0 and "no index" in e.render_status()

    s = e.refresh()
    assert (s["total_files"], s["tracked_files"], s["skipped_files"]) == (3, 4, 1)
    assert s["by_type"] == {"file_summary": 3, "constant": 1, "route": 1, "function": 1, "class": 1, "section": 3}
    ids = sorted(r[0] for r in e.chunks().select("id").collect())
    assert ids == list(range(1, len(ids) + 1))

    top = e.search_code("user login", 3).collect()
    assert top[0]["symbol_name"] == "login" and top[0]["score"] >= top[1]["score"] and len(top) == 3
    assert [r["symbol_name"] for r in e.search_symbol("LOAD").collect()] == ["loadUsers"]
    assert e.search_symbol("o", "class").count() == 1
    assert [r["symbol_type"] for r in e.file_overview("src\\app.py").collect()] == ["file_summary", "constant", "route"]
    assert e.search_similar(e.vectors("login"), 2).count() == 2 and e.search_text("database", 2).count() == 2
    assert "## Languages" in e.project_summary() and "relevance" in e.render_search("login") and "login" in e.render_symbols("login") + e.render_overview("src/app.py")
    with pytest.raises(ValueError):
        e.search_code("x", 0)
    # without a query vector the text leg answers alone; without a hit, substrings do
    e.vectors.embedder = type("No", (), {"dimension": 3, "encode": lambda self, t: 1 / 0})()
    assert e.search_code("database", 2).first()["score"] is None
    assert {r["symbol_name"] for r in e.search_code("oadUser").collect()} >= {"loadUsers"}

    before = e.store.manifest()
    e.refresh()
    assert e.store.manifest() == before

    write(root, "src/app.py", "def brand_new():\n    return 2\n")
    os.remove(root / "web/a.js")
    write(root, "new.md", "some new text here")
    os.utime(root / "README.md", (1, 1))
    write(root, "gen.py", "# fine now\ny = 2\n")
    s = e.refresh()
    assert s["meta"]["files_reindexed"] == "3" and s["meta"]["files_deleted"] == "1"
    tracked = {r["file_path"]: r for r in e.store.tracking(e.store.manifest()).collect()}
    assert set(tracked) == {"src/app.py", "README.md", "new.md", "gen.py"} and tracked["README.md"]["file_mtime"] == 1.0
    assert e.search_symbol("login").count() == 0 and e.search_symbol("brand").count() == 1

    other = Engine(spark, str(root), index=str(tmp_path / "other"))
    other.refresh(full=True)
    assert rows(e) == rows(other)
    a, b = e.store.manifest(), other.store.manifest()
    assert (a.n_chunks, a.n_tokens) == (b.n_chunks, b.n_tokens)
    assert e.store.vacuum(retain=0) > 0 and rows(e) == rows(other)

    # a full build keeps the cache, so nothing is embedded again
    known = other.store.cache(b).count()
    other.refresh(full=True)
    assert other.store.cache(other.store.manifest()).count() == known
    other.store.clear()
    m = other.store.manifest()
    assert other.chunks().count() == 0 and other.store.tracking(m).count() == 0 and other.store.cache(m).count() == known and other.store.meta(m).count() == 0

    with e.store.lock(), pytest.raises(StoreLocked):
        e.refresh(full=True)
    assert e.refresh(full=True)["indexed"]


def test_of_two_writers_one_publishes(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "i")), Store(spark, str(tmp_path / "i"))
    m, late = Manifest(), Manifest()
    a.publish(m)
    with pytest.raises(StoreMoved):
        b.publish(late)
    assert (m.version, late.version, a.manifest().version) == (1, 0, 1)
    with a.lock() as first:
        first.check()
        with pytest.raises(StoreLocked), b.lock():
            pass
        os.utime(tmp_path / "i" / "LOCK", (1, 1))  # without a sign of life
        with b.lock() as second:
            second.check()
            with pytest.raises(StoreMoved):
                first.check()
            first.__exit__()
            second.check()
    assert not (tmp_path / "i" / "LOCK").exists()


def test_a_writer_gives_signs_of_life(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "STALE", 1.0)
    a = Store(spark, str(tmp_path / "i"))
    with a.lock():
        time.sleep(2.5)
        with pytest.raises(StoreLocked), Store(spark, a.path).lock():
            pass


def test_layers_are_merged_and_old_files_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "LAYERS", 3)
    root = tmp_path / "p"
    for i in range(12):
        write(root, f"f{i}.md", f"words of file {i}")
    e = Engine(spark, str(root))
    e.refresh()
    for turn in range(3):
        write(root, f"f{turn}.md", f"other words {turn} " * (turn + 1))
        write(root, f"new{turn}.md", f"new words {turn}")
        e.refresh()
    m = e.store.manifest()
    assert len(m.layers) < 3 and len(m.gone) <= 2 and m.n_chunks == e.chunks().count() == 15
    ids = [r[0] for r in e.chunks().select("id").collect()]
    assert len(set(ids)) == 15 and {r[0] for r in e.store.table(m, "vectors").select("id").collect()} == set(ids) == {r[0] for r in e.store.table(m, "postings").select("id").collect()}
    other = Engine(spark, str(root), index=str(tmp_path / "other"))
    other.refresh()
    assert rows(e) == rows(other) and m.n_tokens == other.store.manifest().n_tokens
    there = {p.name for p in (root / e.store.path).iterdir()}
    e.store.vacuum(retain=0)
    left = {p.name for p in (root / e.store.path).iterdir()}
    assert left < there and {*m.layers, *m.gone, *m.caches, m.tracking} <= left and rows(e) == rows(other)


def test_an_empty_project(spark, tmp_path):
    (tmp_path / "p").mkdir()
    e = Engine(spark, str(tmp_path / "p"))
    assert e.refresh()["total_chunks"] == 0 and e.search_code("anything").count() == 0


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "p", "a.py", "def only_one():\n    pass\n")
    assert cli.main(["--full", str(tmp_path / "p")]) == 0
    assert "1 files" in capsys.readouterr().out
    assert cli.main(["--quiet", str(tmp_path / "p")]) == 0 and capsys.readouterr().out == ""
    cli.main(["symbol", "only", "--root", str(tmp_path / "p")])
    assert "only_one" in capsys.readouterr().out
    cli.main(["status", "--root", str(tmp_path / "p")])
    assert "2 chunks" in capsys.readouterr().out


def test_a_stream_takes_in_each_file_once(spark, tmp_path):
    root, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write(root, "a.py", "def one():\n    pass\n")
    write(root, "node_modules/b.py", "def two():\n    pass\n")
    write(root, "gen.py", "# generated by hand\n")
    ingest.ingest(spark, str(root), target, mark).awaitTermination()
    write(root, "c.md", "words and words")
    ingest.ingest(spark, str(root), target, mark).awaitTermination()
    ingest.ingest(spark, str(root), target, mark).awaitTermination()
    assert sorted((r["file_path"], r["symbol_type"]) for r in ingest.chunks(spark, target).collect()) == [("a.py", "file_summary"), ("a.py", "function"), ("c.md", "file_summary")]
