import ast
from collections import Counter

from sparkloom.operators import code
from sparkloom.plans import code_queries
from sparkloom.sources import manifests, python_ast


def test_nodes_equal_a_plain_walk(spark):
    rows = code_queries.nodes(spark).collect()
    for path, source in code_queries.CORPUS:
        own = [r for r in rows if r["path"] == path]
        try:
            tree = ast.parse(source)
        except SyntaxError:
            assert [r["kind"] for r in own] == ["SyntaxError"]
            continue
        walk = [type(n).__name__ for n in ast.walk(tree)]
        assert [r["kind"] for r in sorted(own, key=lambda r: r["bfs"])] == walk
        assert Counter(r["parent_id"] for r in own)[-1] == 1


def test_deep_trees(spark):
    deep = "x = " + "(" * 80 + "1" + ")" * 80 + "\n" + "y = " + "+".join(["1"] * 600) + "\n"
    files = spark.createDataFrame([("deep.py", deep), ("none.py", None)], "path string, source string")
    assert python_ast.parse(files).where("path = 'deep.py'").count() > 1200


def snippet(spark, source, path="m.py"):
    return python_ast.parse(spark.createDataFrame([(path, source)], "path string, source string"))


def test_recursion_is_still_dead_and_cross_file_use_is_not(spark):
    files = spark.createDataFrame([("lib.py", "def used():\n    pass\n\ndef _alone(n):\n    return _alone(n)\n"), ("app.py", "from lib import used\nused()\n")], "path string, source string")
    assert [r["name"] for r in code.dead_definitions(python_ast.parse(files)).collect()] == ["_alone"]


def test_reflection_and_exports_count_as_use(spark):
    tree = snippet(spark, "__all__ = ['shown']\n\ndef shown():\n    pass\n\ndef named():\n    return getattr(x, 'named')\n\ngetattr(x, 'named')\n")
    assert code.dead_definitions(tree).count() == 0


def test_branchy(spark):
    source = "def f(x):\n" + "".join(f"    if x == {i}:\n        return {i}\n" for i in range(15))
    assert code.complexity(snippet(spark, source)).first()["complexity"] == 16


def test_unused_local(spark):
    rows = code.unused_locals(snippet(spark, "def f(a):\n    used = a\n    spare = 2\n    return used\n")).collect()
    assert [(r["function"], r["name"]) for r in rows] == [("f", "spare")]


def test_test_files_are_one_rung_lower(spark):
    source = "import pickle\npickle.loads(b'')\n"
    files = spark.createDataFrame([("app.py", source), ("tests/test_app.py", source)], "path string, source string")
    got = {r["path"]: r["severity"] for r in code.security(python_ast.parse(files)).collect()}
    assert got == {"app.py": "high", "tests/test_app.py": "medium"}


def test_sql_and_tls(spark):
    source = "cur.execute(f'SELECT {x}')\ncur.execute('SELECT ?', (x,))\nrequests.get(u, verify=False)\nos.chmod(p, 0o777)\nos.chmod(p, 0o644)\nyaml.load(s, Loader=yaml.SafeLoader)\n"
    got = sorted((r["line"], r["rule"]) for r in code.security(snippet(spark, source)).collect())
    assert got == [(1, "sql_injection"), (3, "tls_verification_disabled"), (4, "world_writable")]


def test_toml(spark):
    source = '[project]\ndependencies = ["Flask==3.0", "numpy"]\n[tool.poetry.dependencies]\npython = "^3.11"\nrequests = "^2.31"\n'
    files = spark.createDataFrame([("pyproject.toml", source), ("x/pyproject.toml", "not toml [")], "path string, source string")
    assert sorted(r["line"] for r in manifests.toml_lines(files).collect()) == ["Flask==3.0", "numpy", "requests>=2.31"]


def test_files_are_read_with_bad_bytes_left_out(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_bytes(b"x = 'caf\xff'\n")
    (tmp_path / "b.txt").write_text("no")
    rows = python_ast.read_files(spark, str(tmp_path)).collect()
    assert [r["source"] for r in rows] == ["x = 'caf'\n"]
