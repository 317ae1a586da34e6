"""Code metrics and rules over the node table of Python files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import findings, quality, usage

FUNCTION = ("FunctionDef", "AsyncFunctionDef")
#: Node kinds that are Halstead operators besides the operator kinds themselves.
OPERATOR_KINDS = (
    "Add", "Sub", "Mult", "MatMult", "Div", "Mod", "Pow", "LShift", "RShift", "BitOr", "BitXor", "BitAnd", "FloorDiv", "Invert", "Not", "UAdd", "USub",
    "And", "Or", "Eq", "NotEq", "Lt", "LtE", "Gt", "GtE", "Is", "IsNot", "In", "NotIn",
)
KEYWORD_KINDS = (
    "If", "For", "AsyncFor", "While", "Try", "With", "AsyncWith", "Return", "Break", "Continue", "Raise", "Assert", "Import", "ImportFrom", "Global", "Nonlocal",
    "Lambda", "Yield", "YieldFrom", "Await", "FunctionDef", "AsyncFunctionDef", "ClassDef", "Assign", "AugAssign", "AnnAssign", "Delete", "Call", "Subscript",
    "comprehension", "IfExp",
)
#: Statements after which a block goes no further, and calls that may read any local name.
TERMINATORS = ("Return", "Raise", "Break", "Continue")
DYNAMIC_SCOPE = ("locals", "vars", "eval", "exec", "globals")


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def yes(name: str) -> Column:
    return F.coalesce(attr(name) == "True", F.lit(False))


def decision_points() -> Column:
    """What a node adds to its function's cyclomatic complexity."""
    number = lambda name: F.coalesce(attr(name).cast("int"), F.lit(0))
    kind = F.col("kind")
    return (
        F.when(kind.isin("If", "IfExp", "ExceptHandler", "Assert"), 1)
        .when(kind.isin("For", "AsyncFor", "While"), F.lit(1) + yes("orelse").cast("int"))
        .when(kind == "Try", yes("orelse").cast("int"))
        .when(kind == "BoolOp", number("values") - 1)
        .when(kind == "comprehension", number("ifs") + 1)
        .when(kind == "match_case", (~yes("wildcard")).cast("int"))
        .otherwise(0)
    )


def complexity(nodes: DataFrame) -> DataFrame:
    """(path, name, lineno, complexity) of each function: 1 and its decision points; nested functions count their own."""
    points = nodes.groupBy("path", F.col("function_id").alias("node_id")).agg(F.sum(decision_points()).alias("points"))
    functions = nodes.where(F.col("kind").isin(*FUNCTION)).select("path", "node_id", "name", "lineno")
    return functions.join(points, ["path", "node_id"], "left").select("path", "name", "lineno", (F.coalesce("points", F.lit(0)) + 1).cast("long").alias("complexity"))


def file_complexity(nodes: DataFrame) -> DataFrame:
    """(path, functions, total, average, maximum) of every file, those without functions too; average to two places."""
    paths = nodes.select("path").distinct()
    rows = complexity(nodes).groupBy("path").agg(F.count("*").alias("functions"), F.sum("complexity").alias("total"), F.round(F.avg("complexity"), 2).alias("average"), F.max("complexity").alias("maximum"))
    zero = {"functions": 0, "total": 0, "average": 0.0, "maximum": 0}
    return paths.join(rows, "path", "left").na.fill(zero)


def high_risk(nodes: DataFrame, above: int = 10) -> DataFrame:
    """Functions more complex than `above`, the most complex first."""
    return complexity(nodes).where(F.col("complexity") > above).orderBy(F.desc("complexity"), "path", "lineno")


def halstead(nodes: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind").isin(*OPERATOR_KINDS, *KEYWORD_KINDS), "operator").when(F.col("kind").isin("Name", "arg", "Attribute", "Constant"), "operand")
    token = F.when(kind == "operator", F.col("kind")).when(F.col("kind") == "Constant", F.concat(F.lit("const:"), attr("value"))).otherwise(F.col("name"))
    return quality.halstead(nodes.select("path", kind.alias("kind"), token.alias("token")).where("kind IS NOT NULL"), "path")


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("path").agg(F.count_if(F.col("kind").isin(*FUNCTION)).alias("functions"), F.count_if(F.col("kind") == "ClassDef").alias("classes"))


def _rules(rules: list[tuple[str, str, Column]]) -> Column:
    found = F.array(*[F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity, when in rules])
    return F.explode(F.filter(found, lambda x: x.isNotNull()))


def security(nodes: DataFrame) -> DataFrame:
    """(path, line, rule, severity, in_test): dangerous calls and assertions, one rung lower in tests."""
    call, func, simple = F.col("kind") == "Call", attr("func"), attr("simple")
    off = lambda name: F.coalesce(attr(name) == "False", F.lit(False))
    rules = [
        ("dangerous_eval", "critical", call & yes("bare") & simple.isin("eval", "exec")),
        ("shell_command", "high", call & func.isin("os.system", "os.popen", "commands.getoutput", "commands.getstatusoutput")),
        ("subprocess_shell", "high", call & func.startswith("subprocess.") & yes("kw_shell")),
        ("unsafe_deserialization", "high", call & func.isin("pickle.load", "pickle.loads", "cPickle.load", "cPickle.loads", "dill.load", "dill.loads", "shelve.open", "marshal.load", "marshal.loads", "jsonpickle.decode")),
        ("unsafe_yaml", "high", call & func.isin("yaml.load", "yaml.load_all") & ~F.coalesce(attr("kw_Loader").contains("Safe"), F.lit(False))),
        ("weak_hash", "medium", call & func.isin("hashlib.md5", "hashlib.sha1") & ~off("kw_usedforsecurity")),
        ("insecure_temp_file", "medium", call & (func == "tempfile.mktemp")),
        ("tls_verification_disabled", "high", call & ((off("kw_verify") & (func.startswith("requests.") | func.startswith("httpx.") | simple.isin("get", "post", "put", "patch", "delete", "request"))) | (func == "ssl._create_unverified_context"))),
        ("sql_injection", "critical", call & simple.isin("execute", "executemany", "executescript", "raw") & yes("dynamic")),
        ("debug_enabled", "medium", call & (simple == "run") & yes("kw_debug")),
        ("world_writable", "medium", call & (func == "os.chmod") & (F.coalesce(F.nullif(attr("mode"), F.lit("")).try_cast("int"), F.lit(0)).bitwiseAND(F.lit(2)) != 0)),
        ("xml_external_entity", "medium", call & func.isin("xml.etree.ElementTree.fromstring", "xml.etree.ElementTree.parse", "xml.dom.minidom.parse", "xml.dom.minidom.parseString", "xml.sax.parse")),
        ("assert_for_validation", "low", F.col("kind") == "Assert"),
    ]
    from sparkloom.functions import scoring

    rows = nodes.where(F.col("kind").isin("Call", "Assert")).select("path", F.col("lineno").alias("line"), _rules(rules).alias("r"))
    test = text.is_test_path(F.col("path"))
    rows = rows.select("path", "line", "r.rule", "r.severity", test.alias("in_test")).where(~(F.col("in_test") & (F.col("rule") == "assert_for_validation")))
    return rows.withColumn("severity", F.when(F.col("in_test"), scoring.downgrade(F.col("severity"))).otherwise(F.col("severity")))


def secrets(nodes: DataFrame) -> DataFrame:
    """(path, line, rule, severity, match): literals with telling names first, then known formats, then entropy."""
    literals = nodes.where((F.col("kind") == "Constant") & attr("text").isNotNull()).select("path", "node_id", "parent_id", "field", "bfs", F.col("lineno").alias("line"), attr("text").alias("value"))
    assigned = nodes.where(F.col("kind").isin("Assign", "AnnAssign")).select("path", F.col("node_id").alias("parent_id"))
    targets = nodes.where(F.col("kind").isin("Name", "Attribute") & F.col("field").isin("targets", "target")).select("path", "parent_id", "name", "idx")
    named = literals.where("field = 'value'").join(assigned, ["path", "parent_id"]).join(targets, ["path", "parent_id"])
    named = named.where(text.is_secret_assignment(F.col("name"), F.col("value"))).select("path", "line", "value", F.lit("hardcoded_secret").alias("rule"), F.lit("high").alias("severity"), F.lit(1).alias("pass"), (F.col("bfs") * 1000 + F.col("idx")).alias("at"))
    known, severity = text.signature(F.col("value"))
    random_ = (F.length("value") >= 20) & F.rlike(F.col("value"), F.lit(text.KEY_LIKE)) & ~text.is_placeholder(F.col("value")) & (text.entropy(F.col("value")) >= 4.0)
    other = literals.withColumn("known", known).withColumn("severity", F.when(F.col("known").isNotNull(), severity).when(random_, "medium"))
    other = other.where("severity IS NOT NULL").select("path", "line", "value", F.coalesce(F.concat(F.lit("exposed_"), "known"), F.lit("high_entropy_string")).alias("rule"), "severity", F.lit(2).alias("pass"), (F.col("bfs") * 1000).alias("at"))
    return findings.dedupe_findings(named.unionByName(other)).select("path", "line", "rule", "severity", text.redact(F.col("value")).alias("match"))


def practices(nodes: DataFrame) -> DataFrame:
    """(path, line, rule)."""
    call = F.col("kind") == "Call"
    function = F.col("kind").isin(*FUNCTION)
    rules = [
        ("bare_except", "", (F.col("kind") == "ExceptHandler") & yes("bare")),
        ("too_many_args", "", function & (F.coalesce(attr("args").cast("int"), F.lit(0)) > 5)),
        ("wildcard_import", "", (F.col("kind") == "ImportFrom") & yes("star")),
        ("dangerous_call", "", call & yes("bare") & attr("simple").isin("eval", "exec")),
    ]
    rows = nodes.select("path", F.col("lineno").alias("line"), _rules(rules).alias("r")).select("path", "line", F.col("r.rule").alias("rule"))
    mutable = F.coalesce(attr("mutable_defaults").cast("int"), F.lit(0))
    defaults = nodes.where(function & (mutable > 0)).select("path", F.col("lineno").alias("line"), F.explode(F.sequence(F.lit(1), mutable)).alias("nth"))
    rows = rows.unionByName(defaults.select("path", "line", F.lit("mutable_default_arg").alias("rule")))
    globals_ = nodes.where(F.col("kind") == "Global").select("path", F.col("lineno").alias("line"), F.explode(F.split(attr("names"), ",")).alias("name"))
    return rows.unionByName(globals_.select("path", "line", F.lit("global_variable").alias("rule")))


def all_findings(nodes: DataFrame) -> DataFrame:
    """(path, line, rule, severity, in_test) of calls, assertions and secrets; all of a test file's one rung lower."""
    from sparkloom.functions import scoring

    test = text.is_test_path(F.col("path"))
    found = secrets(nodes).select("path", "line", "rule", F.when(test, scoring.downgrade(F.col("severity"))).otherwise(F.col("severity")).alias("severity"), test.alias("in_test"))
    return security(nodes).unionByName(found)


def dead_items(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(category, path, name, lineno, lines, confidence) of everything dead: functions, classes, imports, locals, and
    statements that nothing reaches."""
    none = F.lit(None).cast("string")
    defined = dead_definitions(nodes).select(F.when(F.col("kind") == "class", "class").otherwise("function").alias("category"), "path", "name", "lineno", F.col("lines").cast("long").alias("lines"), "confidence")
    other = lambda rows, category, name, lines=F.lit(0): rows.select(F.lit(category).alias("category"), "path", name.alias("name"), "lineno", lines.cast("long").alias("lines"), none.alias("confidence"))
    return (
        defined.unionByName(other(unused_imports(nodes, files), "import", F.col("name")))
        .unionByName(other(unused_locals(nodes), "local", F.col("name")))
        .unionByName(other(unreachable(nodes), "unreachable", none, F.col("remaining")))
    )


def hinted_functions(nodes: DataFrame) -> DataFrame:
    """(path, name, label, lineno, parameters, filled): label is the name with its class before it."""
    classes = nodes.where("kind = 'ClassDef'").select("path", F.col("node_id").alias("parent_id"), F.col("name").alias("owner"))
    rows = nodes.where(F.col("kind").isin(*FUNCTION)).join(classes, ["path", "parent_id"], "left")
    return rows.select("path", "name", F.concat_ws(".", "owner", "name").alias("label"), "lineno", (attr("slots").cast("long") - 1).alias("parameters"), attr("filled").cast("long").alias("filled"))


def annotated_variables(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("path").agg(F.count_if(F.col("kind") == "AnnAssign").alias("annotated_variables"))


def type_hints(nodes: DataFrame) -> DataFrame:
    """Coverage per file: parameters but self and cls, and the return value."""
    slots = nodes.where(F.col("kind").isin(*FUNCTION)).select("path", attr("filled").cast("long").alias("filled"), attr("slots").cast("long").alias("total"))
    return usage.coverage(slots, "path")


def uses(nodes: DataFrame) -> DataFrame:
    """(path, node_id, function_id, class_id, name): names read, attributes touched, names given to getattr and its
    kin, and strings in __all__."""
    plain = nodes.where(((F.col("kind") == "Name") & (attr("ctx") == "Load")) | (F.col("kind") == "Attribute")).select("path", "node_id", "name")
    reflective = nodes.where((F.col("kind") == "Call") & yes("bare") & attr("simple").isin("getattr", "setattr", "hasattr", "delattr") & attr("second").isNotNull())
    reflective = reflective.select("path", "node_id", F.regexp_extract(attr("second"), r"^'(.*)'$", 1).alias("name"))
    lists = nodes.where((F.col("kind") == "Name") & (F.col("name") == "__all__") & (F.col("field") == "targets")).select("path", F.col("parent_id").alias("assign"))
    held = nodes.where("field = 'value' AND kind IN ('List', 'Tuple')").select("path", F.col("parent_id").alias("assign"), F.col("node_id").alias("parent_id"))
    exported = nodes.where(attr("text").isNotNull()).join(lists.join(held, ["path", "assign"]), ["path", "parent_id"]).select("path", "node_id", attr("text").alias("name"))
    return plain.unionByName(reflective).unionByName(exported)


def definitions(nodes: DataFrame) -> DataFrame:
    """(path, name, kind, lineno, lines, owner, decorators, inherits, is_private, is_package_init, node_id, last_id)."""
    classes = nodes.where("kind = 'ClassDef'").select("path", F.col("node_id").alias("parent_id"), F.col("name").alias("owner"), (attr("bases").cast("int") > 0).alias("inherits"))
    last = nodes.groupBy("path").agg(F.max("node_id").alias("file_last"))
    rows = nodes.where(F.col("kind").isin(*FUNCTION, "ClassDef")).join(classes, ["path", "parent_id"], "left").join(last, "path")
    kind = F.when(F.col("kind") == "ClassDef", "class").when(F.col("owner").isNotNull(), "method").otherwise("function")
    decorators = F.filter(F.split(F.coalesce(attr("decorators"), F.lit("")), ","), lambda d: d != "")
    private = F.col("name").startswith("_") & ~(F.col("name").startswith("__") & F.col("name").endswith("__"))
    return rows.select("path", "name", kind.alias("kind"), "lineno", (F.col("end_lineno") - F.col("lineno") + 1).alias("lines"), "end_lineno", "owner", decorators.alias("decorators"), F.coalesce("inherits", F.lit(False)).alias("inherits"), private.alias("is_private"), (text.basename(F.col("path")) == "__init__.py").alias("is_package_init"), "node_id", "depth")


def dead_definitions(nodes: DataFrame) -> DataFrame:
    """(path, name, kind, lineno, lines, confidence) of definitions used nowhere but in their own body."""
    defined, used = definitions(nodes), uses(nodes)
    defined = defined.where(~usage.reached_by_convention(defined))
    by_line = used.join(nodes.select("path", "node_id", "lineno"), ["path", "node_id"])
    inside = defined.select("path", F.col("node_id").alias("def_id"), "name", F.col("lineno").alias("low"), F.col("end_lineno").alias("high")).join(by_line, ["path", "name"]).where("lineno BETWEEN low AND high")
    own = inside.groupBy("path", F.col("def_id").alias("node_id")).agg(F.count("*").alias("n"))
    total = used.groupBy("name").agg(F.count("*").alias("n"))
    rows = usage.unused(defined, total, own, ["path", "node_id"])
    return rows.select("path", "name", "kind", "lineno", "lines", usage.confidence(rows).alias("confidence"))


def unused_imports(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, lineno) of imported names that their file never uses; noqa lines and packages' roots are spared."""
    modules = nodes.where(F.col("kind").isin("Import", "ImportFrom")).select("path", F.col("node_id").alias("parent_id"), F.col("lineno").alias("at"), F.coalesce(attr("module"), F.lit("")).alias("module"))
    bound = nodes.where("kind = 'alias'").join(modules, ["path", "parent_id"]).where((F.col("module") != "__future__") & ~F.col("name").isin("*", "annotations") & (text.basename(F.col("path")) != "__init__.py"))
    bound = bound.join(files.select("path", F.split("source", "\n").alias("lines")), "path").where(~F.lower(F.element_at("lines", F.col("at"))).contains("# noqa"))
    return usage.unused_in_scope(bound.select("path", "name", F.col("at").alias("lineno")), uses(nodes).select("path", "name").distinct(), ["path", "name"])


def unused_locals(nodes: DataFrame) -> DataFrame:
    """(path, function, name, lineno) of plain local assignments that their function never reads."""
    inside = nodes.where("function_id >= 0")
    stored = inside.where((F.col("kind") == "Name") & (attr("ctx") == "Store") & F.col("field").isin("targets", "target") & ~F.col("name").startswith("__") & (F.col("name") != "_"))
    parents = nodes.where(F.col("kind").isin("Assign", "AnnAssign")).select("path", F.col("node_id").alias("parent_id"))
    local = stored.join(parents, ["path", "parent_id"], "left_semi").select("path", "function_id", "name", "lineno")
    read = inside.where((F.col("kind") == "Name") & (attr("ctx") != "Store")).select("path", "function_id", "name")
    params = inside.where("kind = 'arg'").select("path", "function_id", "name")
    shared = inside.where(F.col("kind").isin("Global", "Nonlocal")).select("path", "function_id", F.explode(F.split(F.coalesce(attr("names"), F.lit("")), ",")).alias("name"))
    nested = inside.where(F.col("kind").isin(*FUNCTION, "Lambda")).select("path", F.col("node_id").alias("inner"), "function_id")
    closed = nested.join(inside.where("kind = 'Name'").select("path", F.col("function_id").alias("inner"), "name"), ["path", "inner"]).select("path", "function_id", "name")
    dynamic = inside.where((F.col("kind") == "Call") & yes("bare") & attr("simple").isin(*DYNAMIC_SCOPE)).select("path", "function_id").distinct()
    known = read.union(params).union(shared).union(closed).distinct()
    rows = local.join(known, ["path", "function_id", "name"], "left_anti").join(dynamic, ["path", "function_id"], "left_anti")
    functions = nodes.where(F.col("kind").isin(*FUNCTION)).select("path", F.col("node_id").alias("function_id"), F.col("name").alias("function"))
    return rows.join(functions, ["path", "function_id"]).groupBy("path", "function", "name").agg(F.min("lineno").alias("lineno"))


def unreachable(nodes: DataFrame) -> DataFrame:
    """(path, lineno, remaining) of the statement after a block's first terminator."""
    statements = nodes.where(F.col("field").isin("body", "orelse", "finalbody") & F.col("lineno").isNotNull())
    rows = statements.select("path", F.concat_ws(":", "path", "parent_id", "field").alias("block"), "idx", "kind", "lineno")
    found = usage.unreachable(rows, "block", "idx", F.col("kind").isin(*TERMINATORS))
    at = rows.select("path", "block", F.col("idx").alias("unreachable"), "lineno")
    return found.join(at, ["block", "unreachable"]).select("path", "lineno", "remaining")
