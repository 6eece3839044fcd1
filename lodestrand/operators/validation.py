"""Constraints of packages as relations: each check gives (path, code) rows of what is broken, all at once.

Paths name a table, a position and a field, as ``files[3].id``. Positions are explicit columns, unique but with gaps allowed, so the
stored order survives any partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions import ids

from . import order

INVALID_REFERENCE, INVALID_RANGE, INVALID_FILE, INVALID_ID, INVALID_NAME = "invalid_reference", "invalid_range", "invalid_file", "invalid_id", "invalid_name"
INVALID_TYPE, INVALID_COMPLETENESS, DUPLICATE_ID, BAD_ORDER, LIMIT = "invalid_type", "invalid_completeness", "duplicate_id", "non_canonical_order", "limit_exceeded"
INVALID_TARGET = "invalid_target"


def at(table: str, position: str, field: str = "") -> Column:
    return F.concat(F.lit(f"{table}["), F.col(position).cast("string"), F.lit("]" + (f".{field}" if field else "")))


def broken(df: DataFrame, path: Column, code: str | Column) -> DataFrame:
    return df.select(path.alias("path"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def limit_violations(tables: dict[str, DataFrame], limits: dict[str, int]) -> DataFrame:
    """Tables with more rows than allowed; one count each, no row is fetched."""
    counts = [tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("path"), F.col("n"), F.lit(n).alias("most")) for t, n in limits.items()]
    return broken(together(*counts).where("n > most"), F.col("path"), LIMIT)


def table_violations(rows: DataFrame, name: str, position: str = "position", key: str = "id") -> DataFrame:
    """Any keyed table: strictly ordered by key as stored, each key once."""
    unordered = broken(order.order_breaks(rows.select(position, key), position, [key]), at(name, position), BAD_ORDER)
    return unordered.unionByName(broken(order.repeats(rows.select(position, key), [key], position), at(name, position, key), DUPLICATE_ID))


def file_violations(files: DataFrame) -> DataFrame:
    """Files (position, id, logical_path, byte_len, line_starts): table rules, canonical paths, ids that follow from paths, line starts that begin at zero, rise and stay inside."""
    starts = F.col("line_starts")
    rising = F.forall(F.sequence(F.lit(1), F.size(starts) - 1), lambda k: starts[k - 1] < starts[k])
    good = (F.size(starts) > 0) & (F.get(starts, F.lit(0)) == 0) & F.when(F.size(starts) > 1, rising).otherwise(F.lit(True)) & (F.element_at(starts, -1) <= F.col("byte_len"))
    own = [
        (~F.col("logical_path").eqNullSafe(ids.logical_path(F.col("logical_path"))) | F.col("logical_path").isNull(), "logical_path", INVALID_FILE),
        (~F.col("id").eqNullSafe(ids.file_id(F.col("logical_path"))) | F.col("id").isNull(), "id", INVALID_ID),
        (~F.coalesce(F.when(F.size(starts) > 0, good), F.lit(False)), "line_starts", INVALID_FILE),
    ]
    return table_violations(files, "files").unionByName(row_violations(files, "files", own))


def row_violations(rows: DataFrame, name: str, rules: list[tuple[Column, str, str]], position: str = "position") -> DataFrame:
    """Rules (condition that is broken, field, code) of single rows, all in one pass over the table."""
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f).alias("f"), F.lit(code).alias("code"))) for bad, f, code in rules]), lambda x: x.isNotNull())
    held = rows.select(F.col(position), F.explode(found).alias("x"))
    return held.select(F.concat(F.lit(f"{name}["), F.col(position).cast("string"), F.lit("]."), F.col("x.f")).alias("path"), F.col("x.code").alias("code"))


def reference_violations(references: DataFrame, keys: DataFrame) -> DataFrame:
    """References (path, kind, id, start, end, role) against keys (kind, id, byte_len, role), of all kinds in one join.

    One without a match is dangling; a range must lie in its file; a role, where both give one, must agree. Null ids refer to nothing.
    """
    held = keys.select(F.col("kind").alias("_kind"), F.col("id").alias("_id"), F.col("byte_len").alias("_len"), F.col("role").alias("_role"))
    met = references.where("id IS NOT NULL").join(held, (F.col("kind") == F.col("_kind")) & (F.col("id") == F.col("_id")), "left")
    code = (
        F.when(F.col("_id").isNull(), INVALID_REFERENCE)
        .when((F.col("start") > F.col("end")) | (F.col("start") < 0) | (F.col("end") > F.col("_len")), INVALID_RANGE)
        .when(F.col("role") != F.col("_role"), INVALID_FILE)
    )
    return broken(met.withColumn("_code", code).where("_code IS NOT NULL"), F.col("path"), F.col("_code"))


def containment_violations(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children (path, parent, file, start, end) that are empty or lie in no range (parent, file, start, end) of their parent."""
    held = parents.select(F.col("parent").alias("_parent"), F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = (F.col("parent") == F.col("_parent")) & (F.col("file") == F.col("_file")) & (F.col("_start") <= F.col("start")) & (F.col("end") <= F.col("_end"))
    full = children.where("start < end").join(held, inside, "left_anti")
    return broken(children.where("NOT coalesce(start < end, false)").unionByName(full), F.col("path"), INVALID_RANGE)


def input_violations(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """Inputs (list, position, id, name, value) against files (position, id, role).

    Entry files are a strictly ordered set of files of that role, and all of them; forced includes exist in any order;
    search paths are canonical; names of defines are identifiers, values plain text; variables are strictly ordered by name.
    """
    entries, forced = inputs.where("list = 'entry_files'"), inputs.where("list = 'forced_includes'")
    of = files.select(F.col("id").alias("_id"), F.col("role").alias("_role"))
    met = entries.unionByName(forced).join(of, F.col("id") == F.col("_id"), "left")
    code = F.when(F.col("_id").isNull(), INVALID_REFERENCE).when((F.col("list") == "entry_files") & (F.col("_role") != "entry"), INVALID_FILE)
    path = lambda field="": F.concat(F.lit("inputs."), F.col("list"), F.lit("["), F.col("position").cast("string"), F.lit("]" + field))
    left_out = files.where("role = 'entry'").join(entries.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    listed = inputs.where("list IN ('define_events', 'variables', 'include_search')")
    plain = ~F.coalesce(F.col("value"), F.lit("")).rlike("[\\x00-\\x08\\x0b-\\x1f\\x7f]")
    bad = (
        F.when((F.col("list") == "include_search") & (~F.col("value").eqNullSafe(ids.logical_path(F.col("value"))) | ~plain), INVALID_FILE)
        .when((F.col("list") == "define_events") & (~F.coalesce(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False)) | ~plain), INVALID_NAME)
        .when((F.col("list") == "variables") & ~F.coalesce(F.col("name").rlike("^[^=\\x00-\\x1f\\x7f]+$"), F.lit(False)), INVALID_NAME)
    )
    return together(
        broken(met.withColumn("_code", code).where("_code IS NOT NULL"), path(), F.col("_code")),
        broken(order.order_breaks(entries.select("position", "id"), "position", ["id"]), at("inputs.entry_files", "position"), BAD_ORDER),
        broken(order.order_breaks(inputs.where("list = 'variables'").select("position", "name"), "position", ["name"]), at("inputs.variables", "position"), BAD_ORDER),
        broken(left_out, at("files", "position", "role"), INVALID_FILE),
        broken(entries.agg(F.count("*").alias("n")).where("n = 0"), F.lit("inputs.entry_files"), INVALID_FILE),
        broken(listed.withColumn("_code", bad).where("_code IS NOT NULL"), path(), F.col("_code")),
    )


REASON = ("code", "message", "file", "start", "end")


def completeness_violations(state: str, reasons: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Reasons (position, code, message, file, start, end) of a package against its diagnostics (the same and impact).

    Reasons are strictly ordered; reasons and distinct forcing diagnostics match one to one; the state is what the worst impact makes it.
    """
    forcing = diagnostics.where("impact > 0").select(*REASON).distinct()
    spelled = F.to_json(F.struct(*REASON))
    unmatched = order.unmatched(reasons.select(*REASON), forcing, REASON)
    worst = diagnostics.agg(F.coalesce(F.max("impact"), F.lit(0)).alias("worst"))
    wanted = {"complete": 0, "partial": 1, "rejected": 2}[state]
    return together(
        broken(order.order_breaks(reasons, "position", list(REASON)), at("completeness.reasons", "position"), BAD_ORDER),
        broken(unmatched, F.concat(F.col("problem"), F.lit(" "), spelled), INVALID_COMPLETENESS),
        broken(worst.where(F.col("worst") != wanted), F.lit("completeness"), INVALID_COMPLETENESS),
    )


def declaration_id_violations(declarations: DataFrame) -> DataFrame:
    """Declarations (position, id, namespace, scope, owner, name, tokens, ordinal): ids follow from names, or from tokens where there is none; names are canonical."""
    name = F.col("name")
    named = ids.entity_id(F.col("namespace"), F.col("scope"), F.col("owner"), name)
    made = F.when(name.isNotNull(), named).otherwise(ids.anonymous_id(F.col("scope"), F.col("owner"), F.col("tokens"), F.col("ordinal")))
    rules = [(~F.col("id").eqNullSafe(made), "id", INVALID_ID), ((F.length(name) == 0) | (name != ids.nfc(name)), "name", INVALID_NAME)]
    return row_violations(declarations, "declarations", rules)


def child_id_violations(children: DataFrame) -> DataFrame:
    """Children (path, parent, id, role, name, tokens, ordinal): ids follow; parameters and the others of one parent are numbered 0, 1, ... by ``ordinal``; no id twice."""
    made = ids.child_id(F.col("parent"), F.col("role"), F.col("name"), F.col("tokens"), F.col("ordinal"))
    count = children.groupBy("parent", "role").agg(F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_distinct("ordinal").alias("k"))
    gaps = count.where("lo <> 0 OR hi <> n - 1 OR k <> n")
    twice = children.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return together(
        broken(children.where(~F.col("id").eqNullSafe(made)), F.concat("path", F.lit(".id")), INVALID_ID),
        broken(gaps, F.concat_ws(".", "parent", "role"), BAD_ORDER),
        broken(twice, F.col("id"), DUPLICATE_ID),
    )


#: Kinds of type nodes without parts, with one, and of a function; and what a node may refer to by its kind.
LEAVES, WRAPPERS = ("void", "bool", "integer", "floating", "complex", "unsupported"), ("pointer", "array")
REFERS_TO = {"alias_ref": "alias", "record_ref": "record", "enum_ref": "enum"}
MOST_DEPTH = 64


def type_violations(nodes: DataFrame, declarations: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Type trees as rows (tree, node, parent, ordinal, kind, context, ref, bound) checked by one join with the parents' rows and one with what is referred to.

    ``node`` is the path from the root, as 0.1.0, so a node's depth is its length and no level is walked. ``context``
    is the root's (general, parameter or field) and what a parent hands down otherwise. Rules: a known kind; a wrapper has one part and
    a leaf none; a function has its result as part 0; no array or function is an array's element or a function's result what it may not be; no
    parameter is void unless alone, none is an array or function; a bound is an unsigned number of an array; references
    are of the kind of declaration that they name; no path is longer than ``most_depth``.
    """
    depth = F.size(F.split("node", "\\.")) - 1
    held = nodes.withColumn("depth", depth)
    above = held.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("kind").alias("_kind"))
    parts = held.where("parent IS NOT NULL").groupBy(F.col("tree").alias("_ptree"), F.col("parent").alias("_parent")).agg(F.count("*").alias("n_parts"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    held = held.join(above, (F.col("tree") == F.col("_tree")) & (F.col("parent") == F.col("_node")), "left").join(parts, (F.col("tree") == F.col("_ptree")) & (F.col("node") == F.col("_parent")), "left")
    held = held.join(declarations.select(F.col("id").alias("_ref"), F.col("kind").alias("_of")), F.col("ref") == F.col("_ref"), "left")
    n, kind = F.coalesce("n_parts", F.lit(0)), F.col("kind")
    refers = F.create_map(*[F.lit(x) for pair in REFERS_TO.items() for x in pair])
    given = (F.col("_kind") == "function") & (F.col("ordinal") > 0)
    code = lambda bad, c, field: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("code"), F.lit(field).alias("f")))
    found = F.array(
        code(~kind.isin(*LEAVES, *WRAPPERS, "function", *REFERS_TO), INVALID_TYPE, "kind"),
        code(kind.isin(*WRAPPERS) & (n != 1) | kind.isin(*LEAVES, *REFERS_TO) & (n != 0) | (kind == "function") & (n < 1), INVALID_TYPE, "parts"),
        code((n > 0) & ((F.col("first") != 0) | (F.col("last") != n - 1)), BAD_ORDER, "parts"),
        code((F.col("_kind") == "array") & kind.isin("function", "void"), INVALID_TYPE, "element"),
        code((F.col("_kind") == "function") & (F.col("ordinal") == 0) & kind.isin("function", "array"), INVALID_TYPE, "result"),
        code((given | (F.col("parent").isNull() & (F.col("context") == "parameter"))) & kind.isin("array", "function", "void"), INVALID_TYPE, "parameter"),
        code(F.col("parent").isNull() & (F.col("context") == "field") & kind.isin("function", "void"), INVALID_TYPE, "field"),
        code(F.col("bound").isNotNull() & ((kind != "array") | ~F.col("bound").rlike("^(0|[1-9][0-9]*)$")), INVALID_TYPE, "bound"),
        code(kind.isin(*REFERS_TO) & F.col("_of").isNull(), INVALID_REFERENCE, "ref"),
        code(kind.isin(*REFERS_TO) & (F.col("_of") != F.try_element_at(refers, kind)), INVALID_REFERENCE, "ref"),
        code(~kind.isin(*REFERS_TO) & F.col("ref").isNotNull(), INVALID_TYPE, "ref"),
        code(F.col("parent").isNotNull() & F.col("_node").isNull(), INVALID_REFERENCE, "parent"),
        code(F.col("depth") > most_depth, LIMIT, "depth"),
    )
    rows = held.select("tree", "node", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return rows.select(F.concat(F.col("tree").cast("string"), F.lit(":"), F.col("node"), F.lit("."), F.col("x.f")).alias("path"), F.col("x.code").alias("code"))


def declaration_rule_violations(declarations: DataFrame) -> DataFrame:
    """Declarations (position, namespace, scope, name, kind, linkage, link_name, convention, support): namespaces follow kinds, internal linkage needs a file's scope, functions have a link name, unmodelled conventions lower support."""
    tag = F.col("kind").isin("record", "enum")
    rules = [
        (F.col("name").isNotNull() & (tag & (F.col("namespace") != "tag") | F.col("kind").isin("function", "alias", "variable") & (F.col("namespace") != "ordinary")), "namespace", INVALID_ID),
        ((F.col("linkage") == "internal") & (F.col("name").isNull() | (F.col("scope") != "file")), "scope", INVALID_ID),
        ((F.col("kind") == "function") & ~F.coalesce(F.length("link_name") > 0, F.lit(False)), "link_name", INVALID_NAME),
        ((F.col("convention") == "unsupported") & (F.col("support") == 0), "support", INVALID_TYPE),
    ]
    return row_violations(declarations, "declarations", rules)


def occurrence_violations(occurrences: DataFrame, declarations: DataFrame, table: str = "occurrences", of: str = "declarations") -> DataFrame:
    """Occurrences (position, of, id, file, start, end, name_start, name_end, tokens, ordinal) of declarations or macros: ids follow and are unique, ranges are not empty and hold the name's, tokens are there, nothing is without one."""
    made = ids.occurrence_id(F.col("of"), F.col("file"), F.col("tokens"), F.col("ordinal"))
    name = F.col("name_start").isNotNull()
    rules = [
        (~F.col("id").eqNullSafe(made), "id", INVALID_ID),
        (F.col("start") >= F.col("end"), "range", INVALID_RANGE),
        (name & ((F.col("name_start") >= F.col("name_end")) | (F.col("name_start") < F.col("start")) | (F.col("name_end") > F.col("end"))), "name_range", INVALID_RANGE),
        (~F.coalesce(F.length("tokens") > 0, F.lit(False)), "tokens", INVALID_NAME),
    ]
    lonely = declarations.join(occurrences.select(F.col("of").alias("_of")).distinct(), F.col("id") == F.col("_of"), "left_anti")
    return together(
        row_violations(occurrences, table, rules),
        broken(order.repeats(occurrences.select("position", "id"), ["id"], "position"), at(table, "position", "id"), DUPLICATE_ID),
        broken(lonely, at(of, "position", "occurrences"), INVALID_ID),
    )


def macro_violations(macros: DataFrame) -> DataFrame:
    """Macros (position, id, file, name): ids follow from file and name, names are identifiers."""
    rules = [(~F.col("id").eqNullSafe(ids.macro_id(F.col("file"), F.col("name"))), "id", INVALID_ID), (~F.coalesce(F.col("name").rlike("^[A-Za-z_$][A-Za-z0-9_$]*$"), F.lit(False)), "name", INVALID_NAME)]
    return table_violations(macros, "macros").unionByName(row_violations(macros, "macros", rules))


def attribute_violations(attributes: DataFrame) -> DataFrame:
    """Attributes (path, name, spelling) without either."""
    return broken(attributes.where("coalesce(name, '') = '' OR coalesce(spelling, '') = ''"), F.col("path"), INVALID_NAME)


#: The order of diagnostics, and that of the places that one is related to.
DIAGNOSED = ("code", "impact", "message", "file", "start", "end", "declaration")
RELATED = ("file", "start", "end", "message")


def diagnostic_violations(diagnostics: DataFrame, target: str | None = None) -> DataFrame:
    """Diagnostics (position, code, impact, message, file, start, end, declaration, and target where one is asked for): strictly ordered, with a message, of the package's target."""
    rules = [(~F.coalesce(F.length("message") > 0, F.lit(False)), "message", INVALID_NAME)]
    if target is not None:
        rules.append((~F.col("target").eqNullSafe(target), "target", INVALID_TARGET))
    breaks = order.order_breaks(diagnostics.select("position", *DIAGNOSED), "position", list(DIAGNOSED))
    return row_violations(diagnostics, "diagnostics", rules).unionByName(broken(breaks, at("diagnostics", "position"), BAD_ORDER))


def related_violations(related: DataFrame) -> DataFrame:
    """Places (of, position, file, start, end, message) that are not strictly above the one before of the same diagnostic (its position); positions are unique within it."""
    was = F.lag(F.struct(*RELATED)).over(W.partitionBy("of").orderBy("position"))
    spot = F.concat(F.lit("diagnostics["), F.col("of").cast("string"), F.lit("].related["), F.col("position").cast("string"), F.lit("]"))
    return broken(related.withColumn("_was", was).where(F.col("_was").isNotNull() & ~(F.col("_was") < F.struct(*RELATED))), spot, BAD_ORDER)


def alias_cycle_violations(nodes: DataFrame, declarations: DataFrame) -> DataFrame:
    """Aliases whose types lead back to them through aliases."""
    from . import closure

    aliases = declarations.where("kind = 'alias'").select("id")
    edges = nodes.where("kind = 'alias_ref' AND ref IS NOT NULL").select(F.col("tree").alias("src"), F.col("ref").alias("dst"))
    edges = edges.join(aliases.withColumnRenamed("id", "_a"), F.col("src") == F.col("_a"), "left_semi")
    return broken(closure.on_cycle(edges), F.col("id"), "alias_cycle")


#: Tables of nested rows that a package may have, each with its path: the field, file, start and end of a reference in it.
NESTED = (
    ("attributes", "range", "file", "start", "end"), ("related", "range", "file", "start", "end"), ("include_chain", "directive", "file", "start", "end"), ("include_chain", "included", "included", None, None),
    ("macro_expansions", "invocation", "file", "start", "end"), ("macro_expansions", "definition", "d_file", "d_start", "d_end"),
)


def all_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(path, kind, id, start, end, role): every reference of a package's tables to a file or declaration, unpivoted."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = []

    def add(name: str, field: str, kind: Column | str, to: str, start: str | None = None, end: str | None = None, role: str | None = None, where: Column | None = None) -> None:
        df = tables[name] if where is None else tables[name].where(where)
        spot = F.col("path") if "path" in df.columns else at(name, "position")
        rows.append(df.select(F.concat(spot, F.lit(f".{field}")).alias("path"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col(to).alias("id"), (F.col(start) if start else none("long")).alias("start"), (F.col(end) if end else none("long")).alias("end"), (F.col(role) if role else none("string")).alias("role")))

    add("declarations", "scope", F.when(F.col("scope") == "file", "file").otherwise("declaration"), "owner", where=F.col("scope") != "unit")
    add("occurrences", "range", "file", "file", "start", "end", "origin")
    add("occurrences", "of", "declaration", "of")
    add("children", "range", "file", "file", "start", "end")
    add("children", "parent", "declaration", "parent")
    add("macros", "file", "file", "file")
    add("macro_occurrences", "range", "file", "file", "start", "end")
    add("diagnostics", "range", "file", "file", "start", "end")
    add("diagnostics", "declaration", "declaration", "declaration")
    for name, field, to, start, end in NESTED:
        if name in tables:
            add(name, field, "file", to, start, end)
    return together(*rows)


def package_violations(tables: dict[str, DataFrame], state: str, limits: dict[str, int] | None = None, target: str | None = None) -> DataFrame:
    """(path, code) of everything that is broken in a package of the tables files, inputs, declarations, occurrences, children, types, macros, macro_occurrences, diagnostics and reasons; distinct, in no order.

    Attributes (path, name, spelling and a range), related places (of, position, message, path and a range), include chains and
    macro expansions (path and ranges, see ``NESTED``) are checked where given. Eight passes: limits, files, declarations with ids, scopes, kinds and occurrences, types, macros, inputs, alias cycles and
    completeness. References and ranges of all tables are one more pass with one join.
    """
    t, files, declarations = tables, tables["files"], tables["declarations"]
    role = lambda df: df.select(F.lit("file").alias("kind"), "id", "byte_len", "role")
    keys = role(files).unionByName(declarations.select(F.lit("declaration").alias("kind"), "id", F.lit(None).cast("long").alias("byte_len"), F.lit(None).cast("string").alias("role")))
    ranges = t["occurrences"].select(F.col("of").alias("parent"), "file", "start", "end")
    nested = [check(t[name]) for name, check in (("attributes", attribute_violations), ("related", related_violations)) if name in t]
    return together(
        *nested,
        diagnostic_violations(t["diagnostics"], target),
        limit_violations(tables, limits or {"files": 16_384, "declarations": 1_000_000, "macros": 1_000_000, "diagnostics": 1_000_000}),
        file_violations(files),
        table_violations(declarations, "declarations"), declaration_id_violations(declarations), declaration_rule_violations(declarations), occurrence_violations(t["occurrences"], declarations),
        child_id_violations(t["children"]), containment_violations(t["children"], ranges),
        reference_violations(all_references(t), keys),
        type_violations(t["types"], declarations), alias_cycle_violations(t["types"], declarations),
        macro_violations(t["macros"]), occurrence_violations(t["macro_occurrences"], t["macros"], "macro_occurrences", "macros"),
        input_violations(t["inputs"], files),
        completeness_violations(state, t["reasons"], t["diagnostics"]),
    ).distinct()
