"""Code queries over a small embedded corpus of Python files, with the expected rows as SQL values."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import code
from sparkloom.sources import commit_log, python_ast

CORPUS = (
    ("app.py", "import os\nimport sys\nfrom helpers import load, unused_name\n\n\ndef main(a, b=[]):\n    total = 0\n    spare = 1\n    for x in range(a):\n        if x > 1 and x < 9:\n            total += load(x)\n        elif x == 3:\n            total -= 1\n    try:\n        print(eval('1'))\n    except:\n        pass\n    return total\n    print(sys.path)\n"),
    ("helpers.py", "import hashlib\n\nAPI_TOKEN = 'q8Zr-41xLmP0'\n\n\ndef load(x: int) -> str:\n    return hashlib.md5(str(x).encode()).hexdigest()\n\n\ndef _orphan(n):\n    return _orphan(n - 1) if n else 0\n\n\nclass Box:\n    def get(self, a: int, b, c=1, d=2, e=3):\n        global counter\n        counter = [i for i in range(a) if i if b]\n        return self\n"),
    ("tests/test_app.py", "import pickle\nfrom app import *\n\n\ndef test_main():\n    assert pickle.loads(b'')\n"),
    ("broken.py", "def broken(:\n"),
)
LOG = (
    "a1\x02Ann\x02Ann@X.org\x022026-01-01T23:30:00-05:00\n3\t1\tsrc/a.py\n-\t-\timg.png\n2\t0\tREADME.md\n",
    "b2\x02\x02bob@x.org\x022026-01-03T10:00:00+00:00\n1\t1\tsrc/{a.py => b.py}\n4\t0\told.py => pkg/new.py\nx\t0\tbad.py\n",
    "c3\x02Cy\x02cy@x.org\x02not a date\n1\t0\tc.py\n",
    "broken header\n1\t0\td.py\n",
)


def files(s):
    return s.createDataFrame(list(CORPUS), "path string, source string")


def nodes(s):
    return python_ast.parse(files(s))


def ast_complexity(s, d):
    return code.complexity(nodes(s)).select("path", "name", "complexity")


def ast_halstead(s, d):
    return code.halstead(nodes(s)).select("path", F.col("n1").cast("long"), F.col("n2").cast("long"), F.col("total_operators").cast("long"), F.col("total_operands").cast("long"))


def ast_security_rules(s, d):
    tree = nodes(s)
    calls = code.security(tree).select("path", "line", "rule", "severity")
    return calls.unionByName(code.secrets(tree).select("path", "line", "rule", "severity"))


def ast_dead_code(s, d):
    tree = nodes(s)
    dead = code.dead_definitions(tree).select("path", "lineno", F.col("kind"), "name")
    imports = code.unused_imports(tree, files(s)).select("path", "lineno", F.lit("import").alias("kind"), "name")
    locals_ = code.unused_locals(tree).select("path", "lineno", F.lit("local").alias("kind"), "name")
    unreached = code.unreachable(tree).select("path", "lineno", F.lit("unreachable").alias("kind"), F.col("remaining").cast("string").alias("name"))
    return dead.unionByName(imports).unionByName(locals_).unionByName(unreached)


def ast_type_hints(s, d):
    out = code.type_hints(nodes(s))
    return out.select("path", F.col("items").cast("long"), F.col("filled").cast("long"), F.col("total").cast("long"), "coverage", "rating")


def ast_bad_practices(s, d):
    return code.practices(nodes(s)).select("path", "line", "rule")


def gitlog_parse(s, d):
    rows = s.createDataFrame([(r,) for r in LOG], "record string")
    return commit_log.changes(rows).select("sha", "author", "email", "local_date", "path", "ins", "dels")


RENAMES = ("a.py", "old.py => new.py", "src/{x => y}/m.py", "src/{ => sub}/m.py", "src/{sub => }/m.py")
PATHS = ("app.py", "tests/test_app.py", "pkg/conftest.py", "pkg/thing_test.py", "test/x.py", "latest/x.py")


def path_rules(s, d):
    renamed = s.createDataFrame([(x,) for x in RENAMES], "raw string").select("raw", text.renamed_path(F.col("raw")).alias("result"))
    tested = s.createDataFrame([(x,) for x in PATHS], "raw string").select("raw", text.is_test_path(F.col("raw")).cast("string").alias("result"))
    repos = s.createDataFrame([("https://host/o/repo.git",), ("https://host/o/repo/",)], "raw string").select("raw", text.repo_name(F.col("raw")).alias("result"))
    return renamed.unionByName(tested).unionByName(repos)


QUERIES = {f.__name__: f for f in (ast_complexity, ast_halstead, ast_security_rules, ast_dead_code, ast_type_hints, ast_bad_practices, gitlog_parse, path_rules)}


def _values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) v({names})"


SQL = {
    "ast_complexity": _values("path, name, complexity", "'app.py', 'main', 6::BIGINT", "'helpers.py', 'load', 1", "'helpers.py', '_orphan', 2", "'helpers.py', 'get', 4", "'tests/test_app.py', 'test_main', 2"),
    "ast_halstead": _values("path, n1, n2, total_operators, total_operands", "'app.py', 16::BIGINT, 16::BIGINT, 24::BIGINT, 27::BIGINT", "'tests/test_app.py', 5, 3, 5, 3", "'helpers.py', 10, 24, 20, 35"),
    "ast_security_rules": _values("path, line, rule, severity", "'app.py', 15, 'dangerous_eval', 'critical'", "'helpers.py', 7, 'weak_hash', 'medium'", "'helpers.py', 3, 'hardcoded_secret', 'high'", "'tests/test_app.py', 6, 'unsafe_deserialization', 'medium'"),
    "ast_dead_code": _values("path, lineno, kind, name", "'helpers.py', 10, 'function', '_orphan'", "'helpers.py', 14, 'class', 'Box'", "'helpers.py', 15, 'method', 'get'", "'app.py', 1, 'import', 'os'", "'app.py', 3, 'import', 'unused_name'", "'app.py', 19, 'unreachable', '1'"),
    "ast_type_hints": _values("path, items, filled, total, coverage, rating", "'app.py', 1::BIGINT, 0::BIGINT, 3::BIGINT, 0.0::DOUBLE, 'Poor'", "'helpers.py', 3, 3, 10, 30.0, 'Poor'", "'tests/test_app.py', 1, 0, 1, 0.0, 'Poor'"),
    "ast_bad_practices": _values("path, line, rule", "'app.py', 6, 'mutable_default_arg'", "'app.py', 15, 'dangerous_call'", "'app.py', 16, 'bare_except'", "'helpers.py', 15, 'too_many_args'", "'helpers.py', 16, 'global_variable'", "'tests/test_app.py', 2, 'wildcard_import'"),
    "gitlog_parse": _values("sha, author, email, local_date, path, ins, dels", "'a1', 'Ann', 'ann@x.org', DATE '2026-01-01', 'src/a.py', 3, 1", "'b2', 'bob@x.org', 'bob@x.org', DATE '2026-01-03', 'src/b.py', 1, 1", "'b2', 'bob@x.org', 'bob@x.org', DATE '2026-01-03', 'pkg/new.py', 4, 0"),
    "path_rules": _values("raw, result", "'a.py', 'a.py'", "'old.py => new.py', 'new.py'", "'src/{x => y}/m.py', 'src/y/m.py'", "'src/{ => sub}/m.py', 'src/sub/m.py'", "'src/{sub => }/m.py', 'src/m.py'", "'app.py', 'false'", "'tests/test_app.py', 'true'", "'pkg/conftest.py', 'true'", "'pkg/thing_test.py', 'true'", "'test/x.py', 'true'", "'latest/x.py', 'false'", "'https://host/o/repo.git', 'repo'", "'https://host/o/repo/', 'repo'"),
}
