import pytest
from pyspark.sql import functions as F
from symdex.operators import chunks as C
from symdex.operators import stats

PY = '''"""The module."""
import os
from a import b

LIMIT = 3
_PRIVATE = 4
name: int = 5
ANNOTATED: int = 6


@app.route("/login", methods=["GET"])
@cached(1, key, "two", 3)
async def login(x):
    """Log in."""
    return x


class Box(Base):
    """A box."""

    SIZE = 1

    def open(self):
        return 1

    @router.put("/x")
    def put(self):
        return 2

    class Inner:
        def hidden(self):
            pass
''' + "\n" * 25 + "    def late(self):\n        return 3\n"


def by_name(found):
    return {c.symbol_name: c for c in found}


def test_python_symbols():
    found = C.chunks_of("pkg/m.py", PY)
    c = by_name(found)
    assert [x.symbol_name for x in found] == ["pkg/m.py", "LIMIT", "login", "Box", "open", "put", "late"]
    assert c["pkg/m.py"].search_text == 'File: pkg/m.py\nDocstring: The module.\nImports: import os; from a import b\n'
    assert c["login"].symbol_type == "route" and c["login"].route_path == "/login"
    assert c["login"].decorators == ["app.route('/login')", "cached(1, 'two')"]
    assert c["login"].source_code.startswith("async def login")
    assert c["login"].search_text.startswith("route: login route=/login\nLog in.\nasync def login")
    assert c["open"].symbol_type == "method" and c["open"].parent_class == "Box"
    assert c["put"].symbol_type == "method" and c["put"].route_path is None
    assert c["open"].search_text.startswith("method: open (in class Box)\n")
    assert c["Box"].line_end > c["Box"].line_start + 20 and len(c["Box"].source_code.splitlines()) <= 21
    assert c["LIMIT"].search_text == "constant: LIMIT\nLIMIT = 3" and c["LIMIT"].docstring is None


def test_decorators_that_are_no_names():
    c = by_name(C.chunks_of("m.py", "@x[0]\n@a.b.c\n@f(g(1))(2)\ndef f():\n    pass\n"))["f"]
    assert c.decorators == ["?", "a.b.c", "f()(2)"]


@pytest.mark.parametrize("text", ["def f(:\n  pass", "x = '\x00'", "(" * 5000])
def test_python_that_cannot_be_parsed_is_plain(text):
    assert [c.symbol_type for c in C.chunks_of("m.py", text)] == ["file_summary"]


JS = """export async function load(a) {
}
  function indented() {}
export default function nope() {}
const add = (a, b) => a + b
let one = x => x
var many = xy => xy
export class Box {}
function load() {}
const typed = (a): number => a
"""


def test_js_symbols():
    found = C.chunks_of("a.tsx", JS)
    assert [(c.symbol_name, c.symbol_type, c.line_start) for c in found[1:]] == [("load", "function", 1), ("add", "function", 5), ("one", "function", 6), ("Box", "class", 8)]
    assert found[1].line_end == 10 and found[0].search_text.startswith("File: a.tsx\nexport async")


PHP = r"""<?php
namespace App\Web;
final readonly class Page {
    const A = 1;
    private const B = 2;
    public static function &render ( $x ) {}
}
interface I {}
trait T {}
enum E {}
abstract class Q {} define('X', 1); define("Y", 2);
FUNCTION loud() {}
"""


def test_php_symbols():
    found = C.chunks_of("a.php", PHP)
    assert [(c.symbol_name, c.symbol_type, c.line_start) for c in found[1:]] == [
        ("App\\Web", "namespace", 2), ("Page", "class", 3), ("Q", "class", 11), ("I", "interface", 8), ("T", "trait", 9), ("E", "enum", 10),
        ("render", "function", 6), ("loud", "function", 12), ("A", "constant", 4), ("B", "constant", 5), ("X", "constant", 11), ("Y", "constant", 11),
    ]


def texts():
    line = "some words here\n"
    return ["", "a", line * 50, line * 51, line * 100 + "x", line * 101, line * 50 + "\n" * 50 + line, line * 50 + "  \n" * 49 + "\t", "é" * 2000 + "\r\n" + line * 60, "a\fb\n" * 40, line * 49 + "last without end", "x" * 600 + "\n" + line * 60]


def test_native_and_python_chunks_agree(spark):
    rows = [(f"d/{i}.txt", t, float(i)) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "file_path string, text string, file_mtime double")
    key = lambda r: (r["file_path"], r["ordinal"], r["symbol_name"], r["symbol_type"], r["line_start"], r["line_end"], r["source_code"], r["search_text"])
    native, other = sorted(map(key, C.plain_chunks(df).collect())), sorted(map(key, C.source_chunks(df).collect()))
    # a blank section takes no number in one and keeps its place in the other: ordinals only order
    assert [k[0:1] + k[2:] for k in native] == [k[0:1] + k[2:] for k in other]


def test_files_go_to_the_chunker_of_their_suffix(spark):
    df = spark.createDataFrame([("a.py", "X = 1\n", 0.0), ("b.md", "words\n", 0.0), ("c.JS", "class A {}\n", 0.0)], "file_path string, text string, file_mtime double")
    found = {(r["file_path"], r["symbol_type"]) for r in C.chunk_files(df).collect()}
    assert found == {("a.py", "file_summary"), ("a.py", "constant"), ("b.md", "file_summary"), ("c.JS", "file_summary"), ("c.JS", "class")}


def test_languages(spark):
    rows = [("a.py", False), ("b.py", False), ("c.xyz", False), ("d.js", True), ("Makefile", None), ("e.RS", None)]
    df = spark.createDataFrame(rows, "file_path string, skipped boolean")
    assert [tuple(r) for r in stats.languages(df).collect()] == [(".py", "Python", 2), (".rs", "Rust", 1), (".xyz", "XYZ", 1)]


def test_content_hash(spark):
    import hashlib

    df = spark.createDataFrame([(b"abc",), (None,)], "c binary")
    assert [r[0] for r in df.select(stats.content_hash(F.col("c"))).collect()] == [hashlib.md5(b"abc").hexdigest(), ""]
