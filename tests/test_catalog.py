"""Text functions, catalogue tables, manifests, patches, sources and chunks."""

import json

import pytest
from pyspark.sql import functions as F

from forgeline.functions import text as T
from forgeline.operators import analytics, catalog, chunking, manifests, patches
from forgeline.sources import repository


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "fn,value,want",
    [
        (T.estimate_tokens, "", 1), (T.estimate_tokens, "x" * 9, 2), (T.terms, "A::b.cc/dd-ee_f(GG) a", ["cc", "dd", "ee", "gg"]), (T.normalized_language, "ProgrammingLanguage.PYTHON", "python"), (T.normalized_language, None, "unknown"), (T.normalized_language, "js", "javascript"),
        (T.language_label, "c-sharp", "C Sharp"), (T.language_label, "", "Unknown language"), (T.path_extension, "a/b.TS", ".ts"), (T.path_extension, "a.b/c", ""), (T.path_stem, "a/b.d.ts", "a/b.d"), (T.directory_name, "..a b/c!", "a_b_c"), (T.is_safe_path, "a/../b", False),
        (T.is_safe_path, "C:\\x", False), (T.is_safe_path, "a/b..c", True), (T.is_protected_path, "x/.env.local", True), (T.is_protected_path, "x/keys.py", False), (T.first_version, ">=1.2,<2", "1.2"), (T.first_version, "latest", None), (T.version_parts, "v1.10.3.4", [1, 10, 3]),
        (lambda c: T.contains(c, " Foo "), "a FOOd", True), (manifests.severity, "10.0", "Critical"), (manifests.severity, "9.8", "High"), (manifests.severity, "CVSS:3.1/AV:N", "Low"), (manifests.severity, None, "Unknown"), (manifests.severity, "5", "Moderate"),
    ],
)
def test_functions(spark, fn, value, want):
    assert one(spark, value, fn) == want


@pytest.mark.parametrize("n,want", [(None, "Not calculated"), (-1, "Not calculated"), (0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (5 << 30, "5.0 GB")])
def test_bytes(spark, n, want):
    assert one(spark, n, T.format_bytes, "long") == want


@pytest.mark.parametrize("url", ["https://git.example/Acme/tool.git", "git@git.example:acme/tool.git", "git.example/acme/tool/", " HTTPS://www.git.example/acme/tool "])
def test_addresses(spark, url):
    assert tuple(one(spark, url, T.repository_identity)) == ("git.example", "acme", "tool")


def test_catalogue_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (2, "B"), (4, "D")], "id long, v string")
    assert sorted((r.id, r.v) for r in catalog.upsert(old, new, ["id"]).collect() if r.v) == [(1, "a"), (2, "B"), (4, "D")]
    assert [r.id for r in catalog.delete_where(old, F.col("v") == "a").orderBy("id").collect()] == [2, 3]
    kids = spark.createDataFrame([(1, "x"), (2, "y")], "parent long, f string")
    left, below = catalog.delete_cascade(old, F.col("id") == 1, {"files": (kids, "parent")})
    assert left.count() == 2 and [r.f for r in below["files"].collect()] == ["y"]
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", None)], "file_path string, checksum string")
    b = spark.createDataFrame([("p", "9"), ("s", "3"), ("r", None)], "file_path string, checksum string")
    assert {(r.file_path, r.change) for r in catalog.changed_files(a, b).collect()} == {("p", "modified"), ("q", "removed"), ("s", "added")}
    t = spark.createDataFrame([("w1", 1), (None, 2)], "workspace_id string, id int")
    assert [r.id for r in catalog.tenant(t, "w1").collect()] == [1]
    with pytest.raises(ValueError):
        catalog.tenant(t, "")
    asked = spark.createDataFrame([("w1", "u"), ("w2", "u")], "workspace_id string, url string")
    known = spark.createDataFrame([("w1", "u")], "workspace_id string, repository_url string")
    assert {(r.workspace_id, r.decision) for r in catalog.import_decisions(asked, known).collect()} == {("w1", "known"), ("w2", "create")}


def test_generations(spark, tmp_path):
    g = catalog.Generations(spark, f"file://{tmp_path}/t")
    assert g.live() is None and g.read() is None
    first = g.stage(spark.range(3))
    assert g.read() is None
    g.publish(first)
    second = g.stage(spark.range(5))
    assert g.read().count() == 3
    g.publish(second)
    assert g.live() == second and g.read().count() == 5 and not (tmp_path / f"t/generation={first}").exists()
    third = g.stage(spark.range(1))
    g.discard(third)
    assert g.read().count() == 5


def test_tree_and_lines(spark):
    files = spark.createDataFrame([(1, "a/b/x.py"), (1, "a/y.py"), (1, "z.py"), (None, "q/q.py"), (1, None)], "repository_id long, file_path string")
    tree = analytics.directory_tree(files)
    assert {(r.dir, r.depth, r.n_files, r.n_below) for r in tree.collect()} == {("a", 1, 1, 2), ("a/b", 2, 1, 1)}
    closed = spark.createDataFrame([], "repository_id long, dir string")
    assert [r.dir for r in analytics.visible_tree(tree, closed).collect()] == ["a"]
    opened = spark.createDataFrame([(1, "a")], "repository_id long, dir string")
    assert sorted(r.dir for r in analytics.visible_tree(tree, opened).collect()) == ["a", "a/b"]
    docs = spark.createDataFrame([(1, "one\nTWO x\n"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.line_no, r.line) for r in analytics.matching_lines(docs, "doc_id", "text", "two").collect()] == [(1, 2, "TWO x")]
    assert analytics.matching_lines(docs, "doc_id", "text", " ").count() == 0


def test_manifests(spark):
    lock = {"packages": {"": {"version": "1"}, "node_modules/axios": {"version": "1.8.2"}, "node_modules/a/node_modules/b": {"version": "2.0.0"}, "node_modules/none": {}}}
    rows = [
        (1, "package-lock.json", json.dumps(lock)), (1, "package.json", '{"dependencies": {"axios": "^1.7.4"}, "devDependencies": {"Jest": "latest"}}'), (1, "requirements.txt", "requests==2.31.0 # pin\n-r other.txt\ngit+https://x\n\nFlask[async]>=2"),
        (1, "pyproject.toml", '[project]\ndependencies = ["numpy>=1.2"]\n[tool.poetry.dependencies]\npython = "^3.11"\nrich = {version = "13.0"}'), (2, "package.json", "{broken"), (2, "other.txt", "x"), (3, "requirements.txt", None),
    ]
    found = manifests.dependencies(spark.createDataFrame(rows, "repository_id long, file_path string, source_code string"))
    merged = {r.name: (r.ecosystem, r.installed, r.source_file) for r in manifests.merged_dependencies(found).collect()}
    assert merged["axios"] == ("npm", "1.8.2", "package-lock.json") and merged["b"][1] == "2.0.0" and merged["Jest"][1] is None
    assert merged["requests"][1] == "2.31.0" and merged["Flask"][1] == "2" and merged["numpy"][1] == "1.2" and merged["rich"][1] == "13.0" and len(merged) == 7
    facts = spark.createDataFrame([("npm", "axios", "1.10.0", []), ("pypi", "requests", "2.31.0", ["x"])], "ecosystem string, name string, latest string, vulnerabilities array<string>")
    status = {r.name: r.status for r in manifests.enriched(manifests.merged_dependencies(found), facts).collect()}
    assert status["axios"] == "outdated" and status["requests"] == "vulnerable" and status["numpy"] == "unknown"
    record = json.dumps({"severity": [{"score": "7.5"}], "affected": [{"versions": ["1.0"], "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.1"}]}]}, {}]})
    v = manifests.vulnerability_rows(spark.createDataFrame([("A", record), ("B", "{}")], "id string, record string")).orderBy("id").collect()
    assert (v[0].severity, v[0].affected_versions, v[0].fixed_versions) == ("High", ["1.0"], ["1.1"]) and v[1].severity == "Unknown"


def test_patches(spark):
    text = "a\nb\nc\n"
    diff = "--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n"
    assert patches.apply_diff(text, diff) == "a\nB\nc\n"
    for bad in ("", "@@ -1,3 +1,3 @@\n a\n-x\n+B\n c\n", "@@ -1,9 +1,9 @@\n a\n", "@@ -9,1 +9,1 @@\n-z\n+y\n"):
        with pytest.raises(patches.PatchError):
            patches.apply_diff(text, bad)
    files = spark.createDataFrame([("f", text), ("g", text)], "file_path string, source_code string")
    edits = spark.createDataFrame([("f", None, diff), ("g", "0" * 64, diff), ("h", None, diff), ("../x", None, diff), (".env", None, diff), ("d", None, diff), ("d", None, diff)], "file_path string, expected_hash string, diff string")
    got = {r.file_path: r.outcome for r in patches.apply_patches(files, edits).collect()}
    assert got == {"f": "applied", "g": "conflict", "h": "missing", "../x": "unsafe", ".env": "protected", "d": "repeated"}


def test_sources(spark, tmp_path):
    for path, body in {"src/main.py": b"x = 1\n", "src/nested/util.ts": b"let a = 1;", "node_modules/p/i.js": b"1", ".git/h.py": b"1", "big.py": b"#" * 50, "notes.md": b"x", "src/bad.py": b"\xff\xfe"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(body)
    plan = repository.parse_plan(repository.listed_files(spark, str(tmp_path)), 49)
    assert {r.file_path: r.outcome for r in plan.collect()} == {"src/main.py": "parse", "src/nested/util.ts": "parse", "big.py": "skip", "notes.md": "skip", "src/bad.py": "parse"}
    assert tuple(repository.run_summary(plan, spark.createDataFrame([("src/bad.py",)], "file_path string")).first()) == (2, 2, 1)
    read = {r.file_path: r.source_code for r in repository.read_sources(spark, str(tmp_path), 50).collect()}
    assert read["src/main.py"] == "x = 1\n" and set(read) == {"src/main.py", "src/nested/util.ts", "big.py", "src/bad.py"} and "�" in read["src/bad.py"]
    with pytest.raises(ValueError):
        repository.file_content(plan, "../x")


def test_broken_python_keeps_its_healthy_part():
    source = "import os\n\n@deco\ndef good(a):\n    return a\n\nclass Broken:\n    x = (1,\n\n    def m(self):\n        return 1\n\n    def bad(self):\n        return ]\n\ndef tail():\n    pass\n"
    assert chunking.chunks_of("python", source) == [("function", "good", None, 3, 5), ("class", "Broken", None, 7, 14), ("method", "m", "Broken", 10, 11), ("method", "bad", "Broken", 13, 14), ("function", "tail", None, 16, 17)]
    assert chunking.chunks_of("python", "<<<<<<< a\nx = 1\n") is None and chunking.chunks_of("python", "def f(:\n  def g(): pass\n") == [("function", "f", None, 1, 2), ("function", "g", None, 2, 2)]


def test_scan_sees_hidden_names_and_prunes(spark, tmp_path):
    for path in ("pkg/__init__.py", "pkg/_util.py", ".hidden.py", "__tests__/a.test.ts", "_private/.deep/x.py", "pkg/build/no.py", "dist/no.py", "a b/ü.py"):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x = 1\n")
    (tmp_path / "empty").mkdir()
    seen = {r.file_path for r in repository.listed_files(spark, str(tmp_path)).collect()}
    assert seen == {"pkg/__init__.py", "pkg/_util.py", ".hidden.py", "__tests__/a.test.ts", "_private/.deep/x.py", "a b/ü.py"}
    assert {r.file_path for r in repository.read_sources(spark, f"file://{tmp_path}").collect()} == seen
    assert repository.listed_files(spark, str(tmp_path / "empty")).count() == 0


def test_generations_survive_a_broken_publication(spark, tmp_path):
    g = catalog.Generations(spark, f"file://{tmp_path}/t")
    first = g.stage(spark.range(3))
    g.publish(first)
    (tmp_path / "t/_pointers/00000000000000000009-nothing").touch()  # a pointer without a generation
    assert g.live() == first and g.read().count() == 3
    with pytest.raises(ValueError):
        g.publish("nothing")
    second = g.stage(spark.range(4))
    g.publish(second)
    assert g.live() == second


def test_requirement_grammar():
    read = lambda line: list(manifests._requirement(line, "runtime"))
    assert read('name[a,b] >= 1.2, < 2 ; python_version < "3.9"  # note')[0][1:3] == ("name", ">= 1.2, < 2")
    assert read("plain")[0][1:3] == ("plain", "") and read("x @ https://host/x.whl")[0][1:3] == ("x", "https://host/x.whl")
    assert not read("-r other.txt") and not read("git+https://host/x") and not read("./local") and not read("# note") and not read("")


def test_proposals(spark):
    good = '{"summary": "s", "edits": [{"file_path": "a.py", "expected_hash": null, "diff": "@@"}]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, good[:-2]), (4, None), (5, "[]"), (6, ""), (7, '{"summary": "s"}')]
    got = {r.k: (r.valid, len(r.edits)) for r in patches.parsed_proposals(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == {1: (True, 1), 2: (True, 1)} | {k: (False, 0) for k in range(3, 8)}


PY = "import os\n\n@wrap\nclass Service:\n    def run(self):\n        def nested():\n            pass\n\n    async def helper(self):\n        pass\n\ndef public_api():\n    return '''\ndef no(): pass\n'''\n"
TS = "import x from 'y';\nexport interface User { id: string }\nenum Kind { A }\nexport async function load(a: string): Promise<void> {\n  if (a) { return; } // }\n}\nexport default class Store {\n  private items = new Map();\n  constructor(a) {}\n  async get(id: string): Promise<string> {\n    return `${id}}`;\n  }\n}\nconst add = (a: number) => {\n  return a;\n};\nconst two = 2;\n"


def test_chunks(spark):
    assert chunking.chunks_of("python", PY) == [("class", "Service", None, 3, 10), ("method", "run", "Service", 5, 7), ("method", "nested", "Service", 6, 7), ("method", "helper", "Service", 9, 10), ("function", "public_api", None, 12, 15)]
    assert chunking.chunks_of("typescript", TS) == [
        ("interface", "User", None, 2, 2), ("enum", "Kind", None, 3, 3), ("function", "load", None, 4, 6), ("class", "Store", None, 7, 13), ("method", "constructor", "Store", 9, 9), ("method", "get", "Store", 10, 12), ("arrow_function", "add", None, 14, 16)
    ]
    assert chunking.chunks_of("python", "def (") is None and chunking.chunks_of("javascript", None) == []
    df = spark.createDataFrame([(1, 7, "./a.PY", PY.replace("\n", "\r\n"), "x"), (2, 7, "b.md", PY, "x"), (3, 7, "c.py", None, "x"), (4, 7, "d.py", "def (", "x")], "file_id long, repository_id long, file_path string, source_code string, symbol_name string")
    rows = chunking.extract_chunks(df).orderBy("start_line").collect()
    assert len(rows) == 5 and rows[1].source_code.startswith("    def run") and rows[0].file_path == "a.PY" and len(rows[0].chunk_key) == 16


NESTED = """(function () {
  function inner(a) {
    const deep = () => a, other = function () { return 1; };
    class Box {
      open({ a, b } = {}, opts: { x: number; y?: string } = {}): { ok: boolean } {
        function unseen() {}
      }
      *[Symbol.iterator]() { yield 1; }
      static async #load<T>(cb: (a: T) => void) {}
      field = foo(1)
      set value(v) { this.v = v; }
      run = () => { function seen() {} };
      sig(a: string): void;
      sig(a: any): void { if (a) { b(a); } }
    }
  }
})();
if (ready) {
  var a = x => x + 1, b = 2,
    c = async (q) => {
      return q;
    };
}
namespace Tools {
  export function pick<T extends { id: string }>(a: T): a is T { return true; }
  export abstract class Base extends Mix({ a: 1 }) { abstract f(): void; g() {} }
}
export function over(a: string): void;
module.exports = { start() { return 1; }, async stop({ now }) {} };
const called = (function () { function hidden() {} })();
const text = "x"
function last() {}
const h: (a: number) => void = (a) => {};
switch (a) { case f(x): { call(a); } default: function dflt() {} }
const cls = class { m() {} };
export default () => { function tail() {} };
"""


def test_chunks_at_any_depth():
    box, found = "Box", chunking.chunks_of("typescript", NESTED)
    assert found == [
        ("function", "inner", None, 2, 16), ("arrow_function", "deep", None, 3, 3), ("arrow_function", "other", None, 3, 3), ("class", box, None, 4, 15), ("method", "open", box, 5, 7), ("method", "[Symbol.iterator]", box, 8, 8), ("method", "#load", box, 9, 9),
        ("method", "value", box, 11, 11), ("function", "seen", box, 12, 12), ("method", "sig", box, 14, 14), ("arrow_function", "a", None, 19, 22), ("arrow_function", "c", None, 19, 22), ("function", "pick", None, 25, 25), ("class", "Base", None, 26, 26), ("method", "g", "Base", 26, 26),
        ("method", "start", None, 29, 29), ("method", "stop", None, 29, 29), ("function", "last", None, 32, 32), ("arrow_function", "h", None, 33, 33), ("function", "dflt", None, 34, 34), ("function", "tail", None, 36, 36),
    ]
    assert chunking.chunks_of("python", "class A:\n  class B:\n    def f(self): pass\n  def g(self): pass\n") == [("class", "A", None, 1, 4), ("class", "B", "A", 2, 3), ("method", "f", "B", 3, 3), ("method", "g", "A", 4, 4)]
    rows = "const rows = (a: Array<{ n: number }>): Record<string, number> => {\n  return {};\n}, two = (b: Map<string, number>) => b as Map<string, number>;\nexport default function f(state = {}, { a }: { a: string } = {}) {\n  return 1;\n}\n"
    assert chunking.chunks_of("typescript", rows) == [("arrow_function", "rows", None, 1, 3), ("arrow_function", "two", None, 1, 3), ("function", "f", None, 4, 6)]
