import os

import pytest
from pyspark.sql import functions as F
from symdex.functions import names as N
from symdex.functions import paths
from symdex.functions.skip import skip_reason
from symdex.sources import corpus

SHAPES = [
    (["plugins", "themes", "mu-plugins", "uploads"], [], True),
    (["plugins", "themes", "uploads"], ["index.php"], True),
    (["plugins", "themes", "uploads"], [], False),
    (["plugins", "themes", "uploads"], ["package.json"], False),
    (["plugins", "themes"], ["index.php"], False),
    (["plugins", "src", "lib"], [], False),
    ([], [], False),
]
TREES = {
    "two": (["plugins/core/mod.py", "themes/dark/style.py", "src/main.py"], False),
    "three": (["plugins/core/mod.py", "themes/dark/style.py", "src/main.py", "uploads/.gitignore"], False),
    "must_use": (["plugins/akismet/a.php", "themes/mychild/functions.php", "mu-plugins/custom/c.php", "uploads/.gitignore"], True),
    "index": (["plugins/akismet/a.php", "themes/mychild/functions.php", "uploads/.gitignore", "index.php"], True),
}


@pytest.mark.parametrize(("dirs", "files", "expected"), SHAPES)
def test_shape_of_a_content_directory(spark, dirs, files, expected):
    assert paths.content_shape(dirs, files) is expected
    df = spark.createDataFrame([(dirs, files)], "d array<string>, f array<string>")
    assert df.select(paths.looks_like_content(F.col("d"), F.col("f"))).first()[0] is expected


@pytest.mark.parametrize("case", TREES)
def test_trees_are_pruned_alike_by_walk_and_by_columns(spark, tmp_path, case):
    files, pruned = TREES[case]
    for f in files:
        path = tmp_path / "site" / f
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1  # enough bytes")
    walked = {p for p, _, _ in corpus.walk(str(tmp_path))}
    assert any("/plugins/" in p for p in walked) is not pruned
    # the walk sees skipped folders' names, the columns only files, so `uploads` is a file's folder there
    listed = spark.createDataFrame([(f"site/{f}",) for f in files], "file_path string")
    kept = {r[0] for r in paths.prune(listed).collect()}
    if case != "index":  # its third mark, uploads, is itself skipped by name
        assert kept == walked


@pytest.mark.parametrize(
    ("path", "ext", "indexed"),
    [("a/b.py", ".py", True), ("a/B.PY", ".PY", True), (".gitignore", "", True), ("x/.hidden", "", False), ("a.", "", False), ("Dockerfile", "", True), ("dockerfile", "", False), ("a.tar.gz", ".gz", False), ("x.d.ts", ".ts", True)],
)
def test_suffixes(spark, path, ext, indexed):
    row = spark.createDataFrame([(path,)], "p string").select(paths.suffix(F.col("p")), paths.is_indexed_name(F.col("p"))).first()
    assert tuple(row) == (ext, indexed)


def test_name_rules(spark):
    rows = [("node_modules/a.js", True), ("src/x.egg-info/a.py", True), ("n/a.py", True), ("src/n/a.py", False), ("lib.old/a.py", True), ("src/a.py", False)]
    df = spark.createDataFrame(rows, "file_path string, gone boolean")
    kept = {r[0] for r in paths.prune(df.select("file_path")).collect()}
    assert kept == {p for p, gone in rows if not gone}
    below = spark.createDataFrame([("a/wp-content/plugins/x.php",), ("a/wp-content/themes/x.php",), ("a/mu-plugins/kinsta-mu-plugins/x.php",)], "file_path string")
    assert [r[0] for r in paths.prune(below).collect()] == ["a/wp-content/themes/x.php"]


def test_fixed_values():
    assert len(N.SKIPPED_DIRS) == 94 and len(N.INDEXED_EXTENSIONS) == 57 and len(N.INDEXED_NAMES) == 19
    assert len(N.SYSTEM_FILES) == 28 and len(N.GENERATED_MARKERS) == 13 and len(N.DEFAULT_THEMES) == 11


REASONS = [
    ("yarn.lock", b"abc", "lock_or_system_file"),
    ("a.min.js", b"abc", "generated_or_minified"),
    ("types.d.ts", b"abc", "generated_or_minified"),
    ("my-lock.json", b"abc", "generated_or_minified"),
    ("a.py", None, "unreadable"),
    ("a.py", b"a" * 4095 + b"\x00", "binary_file"),
    ("a.py", b"a\n" * 2048 + b"\x00", None),
    ("a.py", b"# DO NOT EDIT\n", "auto_generated"),
    ("a.py", b"x\n" * 495 + b"do not edit", None),
    ("a.py", b"x\n" * 493 + b"do not edit", "auto_generated"),
    ("a.py", b"x" * 501, "likely_minified"),
    ("a.py", b"x" * 500 + b"\n\n  \n", None),
    ("a.py", "é".encode() * 300, None),
    ("a.py", b"\xff" * 501, "likely_minified"),
    ("a.py", b"", None),
]


def test_skip_reasons(spark):
    df = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(REASONS)], "i int, n string, c binary")
    found = {r[0]: r[1] for r in df.select("i", skip_reason(F.col("n"), F.col("c"))).collect()}
    assert [found[i] for i in range(len(REASONS))] == [r for _, _, r in REASONS]


def test_size_bounds_and_unsafe_roots(spark, tmp_path):
    for n in (9, 10, 500_000, 500_001):
        (tmp_path / f"f{n}.txt").write_bytes(b"a" * n)
    assert {p for p, _, _ in corpus.walk(str(tmp_path))} == {"f10.txt", "f500000.txt"}
    assert {r[0] for r in corpus.corpus(spark, str(tmp_path)).select("file_path").collect()} == {"f10.txt", "f500000.txt"}
    with pytest.raises(corpus.UnsafeRoot):
        corpus.resolve_root(os.path.expanduser("~"))


def test_text_is_repaired(spark, tmp_path):
    (tmp_path / "a b+c.txt").write_bytes(b"caf\xe9 is bad, \xc3\xa9 is good")
    row = corpus.with_text(corpus.scan(spark, str(tmp_path))).first()
    assert row["file_path"] == "a b+c.txt"
    assert row["text"] == b"caf\xe9 is bad, \xc3\xa9 is good".decode("utf-8", "replace")
