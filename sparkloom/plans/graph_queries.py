"""Registered queries over large graphs: condensation of all programs' blocks and of the links of pages, ancestors of parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import cfg, linking, patching, trie, type_flow
from sparkloom.operators.components import condensation, order
from sparkloom.operators.lineage import JumpTable
from sparkloom.plans import derived, fixpoint
from sparkloom.plans.record_queries import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = fixpoint.scoped(f)
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: From gn (node) and ge (src, dst): mutual reach names the components, path lengths of the condensation rank them.
_CONDENSED = """
clo AS (SELECT src, dst FROM ge UNION SELECT c.src, e.dst FROM clo c JOIN ge e ON e.src = c.dst),
comp AS (
  SELECT n.node, least(n.node, coalesce(min(m.dst), n.node)) AS component FROM gn n
  LEFT JOIN (SELECT a.src, a.dst FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src) m ON m.src = n.node GROUP BY n.node
), cond AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM ge JOIN comp a ON a.node = ge.src JOIN comp b ON b.node = ge.dst WHERE a.component <> b.component),
rk AS (SELECT DISTINCT component, 0 AS d FROM comp UNION SELECT c.src, rk.d + 1 FROM rk JOIN cond c ON c.dst = rk.component)
"""
_RANKED = "SELECT c.node, c.component, r.rank FROM comp c JOIN (SELECT component, max(d) AS rank FROM rk GROUP BY component) r USING (component)"


@query("rg11_condensation", derived.oracle(_RANKED, f"""gn AS (SELECT program_id || ':' || label AS node FROM blk),
ge AS (SELECT program_id || ':' || src AS src, program_id || ':' || dst AS dst FROM edge), {_CONDENSED}"""))
def block_condensation(spark, sf) -> DataFrame:
    """The blocks of all programs as one graph: component and leaves-first rank of every block."""
    placed = fixpoint.once("placed", lambda: cfg.placed(derived.instr(spark, sf)))
    blocks = fixpoint.once("blocks", lambda: cfg.blocks(placed))
    node = lambda c: F.concat(F.col("program_id").cast("string"), F.lit(":"), c)
    edges = cfg.edges(blocks).select(node("src").alias("src"), node("dst").alias("dst"))
    return condensation(blocks.select(node("label").alias("node")), edges)


_LINKS = r"""named AS (SELECT page_id, unnest(l) AS name, generate_subscripts(l, 1) AS at FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]+)', 1) AS l FROM pages)),
ge AS (SELECT DISTINCT a.name AS src, b.name AS dst FROM named a JOIN named b ON b.page_id = a.page_id AND b.at = a.at + 1),
gn AS (SELECT DISTINCT name AS node FROM named)"""


def page_links(spark, sf) -> DataFrame:
    """(page_id, at, name): the names that each page links to, in order."""
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="/([^"]+)'), 1)).alias("at", "name"))


@query("rg11_link_condensation", f"WITH RECURSIVE {_LINKS}, {_CONDENSED} {_RANKED}")
def link_condensation(spark, sf) -> DataFrame:
    """One graph over all pages: a linked name leads to the name linked next on its page."""
    links = page_links(spark, sf)
    after = Window.partitionBy("page_id").orderBy("at")
    edges = links.select(F.col("name").alias("src"), F.lead("name").over(after).alias("dst")).where("dst is not null")
    return condensation(links.select(F.col("name").alias("node")), edges)


_LINEAGE = """up AS (SELECT p_partkey AS node, CASE WHEN p_partkey >= 3 THEN p_partkey // (2 + p_size % 3) END AS up FROM part),
asked AS (
  SELECT DISTINCT a, b FROM (
    SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem
    UNION ALL SELECT l_partkey, l_partkey // 6 FROM lineitem) WHERE b IS NOT NULL
), known AS (SELECT node FROM up UNION SELECT up FROM up WHERE up IS NOT NULL),
anc AS (SELECT node, node AS anc, 0 AS d FROM known UNION SELECT anc.node, up.up, anc.d + 1 FROM anc JOIN up ON up.node = anc.anc WHERE up.up IS NOT NULL),
deep AS (SELECT node, max(d) AS depth FROM anc GROUP BY node)"""


def _lineage(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    parents = table(spark, sf, "part").select(k.alias("node"), F.when(k >= 3, F.floor(k / (2 + F.col("p_size") % 3))).alias("parent"))
    items = table(spark, sf, "lineitem")
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    asked = items.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(line).alias("b")).where("b is not null")
    asked = asked.union(items.select("l_partkey", F.floor(F.col("l_partkey") / 6)))
    return JumpTable(parents).bounds(asked)


@query("rt07_part_lineage", f"""WITH RECURSIVE {_LINEAGE} SELECT a, b, EXISTS (SELECT 1 FROM anc WHERE anc.node = a AND anc.anc = b) AS is_below FROM asked
WHERE a IN (SELECT node FROM known) AND b IN (SELECT node FROM known)""")
def part_lineage(spark, sf) -> DataFrame:
    """Parts as a class graph of single inheritance: for all asked pairs, whether a stands at or below b."""
    return _lineage(spark, sf).select("a", "b", "is_below")


@query("rt09_common_ancestors", f"""WITH RECURSIVE {_LINEAGE} SELECT a, b, (SELECT arg_max(x.anc, deep.depth) FROM anc x JOIN anc y ON x.anc = y.anc JOIN deep ON deep.node = x.anc WHERE x.node = a AND y.node = b) AS bound FROM asked
WHERE a IN (SELECT node FROM known) AND b IN (SELECT node FROM known)""")
def common_ancestors(spark, sf) -> DataFrame:
    """The least upper bound of all asked pairs of parts; null where they have none."""
    return _lineage(spark, sf).select("a", "b", "bound")


def array_programs(spark, sf) -> DataFrame:
    """The derived programs with their last two variables as arrays: stores into v6 and v7 are stores of elements, loads are loads of elements."""
    i = derived.instr(spark, sf)
    name, array = F.get("operands", F.lit(0)), F.get("operands", F.lit(0)).isin("v6", "v7")
    op = F.when((F.col("opcode") == "STORE_VAR") & array, "STORE_INDEX").when((F.col("opcode") == "LOAD_VAR") & array, "LOAD_INDEX").otherwise(F.col("opcode"))
    ops = F.when(array & F.col("opcode").isin("STORE_VAR", "LOAD_VAR"), F.concat(F.array(name, F.lit("0")), F.slice("operands", 2, F.size("operands")))).otherwise(F.col("operands"))
    return i.select("program_id", "pc", op.alias("opcode"), "result_reg", ops.alias("operands"))


#: Types of the derived programs' variables that are given.
VARIABLE_TYPES = {"v0": "Int", "v1": "Float", "v2": "Int", "v3": "Float", "v4": "String"}


@query("rt02_type_flow")
def type_flow_of_programs(spark, sf) -> DataFrame:
    """Types and element types of every name of every program, united over all that flows to it; a plain loop is the test."""
    return type_flow.infer(array_programs(spark, sf), VARIABLE_TYPES)


PROJECTS = 16
_MODULES = f"""exp AS (SELECT DISTINCT i.program_id, i.var AS name FROM ins i JOIN own ON own.program_id = i.program_id AND own.label = i.block WHERE i.opcode = 'STORE_VAR' AND own.func IS NULL),
md AS (SELECT program_id, program_id % {PROJECTS} AS project, count(*) + 1 AS size, coalesce(max(event_id) FILTER (result_reg IS NOT NULL) + 1, 0) AS regs FROM ins GROUP BY program_id),
mb AS (SELECT *, CAST(coalesce(sum(size) OVER before, 0) AS BIGINT) AS start, CAST(coalesce(sum(regs) OVER before, 0) AS BIGINT) AS base, lead(program_id) OVER (PARTITION BY project ORDER BY program_id) AS following FROM md
  WINDOW before AS (PARTITION BY project ORDER BY program_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sym AS (SELECT project, name, min(program_id) AS owner, count(*) AS exporters FROM exp JOIN md USING (program_id) GROUP BY project, name)"""


def _linked(spark, sf) -> DataFrame:
    """The programs of events as modules of projects (number mod ``PROJECTS``), linked in the order of their numbers."""
    return fixpoint.once("linked", lambda: linking.link_table(_code(spark, sf), _modules(spark, sf), _stored(spark, sf)))


def _code(spark, sf) -> DataFrame:
    return fixpoint.once("code", lambda: derived.instr(spark, sf))


def _modules(spark, sf) -> DataFrame:
    return _code(spark, sf).select("program_id").distinct().select(F.pmod("program_id", F.lit(PROJECTS)).alias("project"), "program_id", F.col("program_id").alias("place"))


def _stored(spark, sf) -> DataFrame:
    """(program_id, name): variables stored outside functions, which a module exports."""
    p = fixpoint.once("placed", lambda: cfg.placed(_code(spark, sf)))
    top = cfg.owners(cfg.blocks(p), F.col("label").startswith("L")).where("func is null").select("program_id", F.col("label").alias("block"))
    return p.where("opcode = 'STORE_VAR'").join(top, ["program_id", "block"], "left_semi").select("program_id", F.get("operands", F.lit(0)).alias("name")).distinct()


@query("rl05_merged_symbols", derived.oracle("SELECT project, name, owner, exporters FROM sym", _MODULES))
def merged_symbols(spark, sf) -> DataFrame:
    """Which module of a project a name means where several export it."""
    return linking.merged_symbols(_stored(spark, sf), _modules(spark, sf))


@query("rl07_linked_instructions", derived.oracle("""
SELECT mb.project, mb.start + i.pc + 1 AS pc, i.program_id, i.opcode, '%' || (i.event_id + mb.base) AS result_reg,
  CASE i.opcode WHEN 'LOAD_VAR' THEN v.meant WHEN 'STORE_VAR' THEN concat_ws(' ', v.meant, '%' || (CAST(substr(p1, 2) AS BIGINT) + mb.base))
    WHEN 'BINOP' THEN concat_ws(' ', '+', '%' || (CAST(substr(p2, 2) AS BIGINT) + mb.base), '%' || (CAST(substr(p1, 2) AS BIGINT) + mb.base)) ELSE '' END AS operands,
  CASE WHEN i.opcode = 'LABEL' THEN 'm' || i.program_id || '.L' || i.event_id ELSE '' END AS label
FROM (SELECT *, CASE WHEN result_reg IS NULL THEN NULL ELSE event_id END AS r FROM ins) i JOIN mb USING (program_id) LEFT JOIN nm v ON v.program_id = i.program_id AND v.name = i.var WHERE i.r IS NOT NULL
UNION ALL SELECT mb.project, mb.start + i.pc + 1, i.program_id, i.opcode, NULL,
  CASE i.opcode WHEN 'STORE_VAR' THEN concat_ws(' ', v.meant, '%' || (CAST(substr(p1, 2) AS BIGINT) + mb.base)) ELSE '' END,
  CASE WHEN i.opcode = 'LABEL' THEN 'm' || i.program_id || '.L' || i.event_id ELSE '' END
FROM ins i JOIN mb USING (program_id) LEFT JOIN nm v ON v.program_id = i.program_id AND v.name = i.var WHERE i.result_reg IS NULL
UNION ALL SELECT project, start, program_id, 'LABEL', NULL, '', 'm' || program_id FROM mb""", _MODULES + """,
nm AS (SELECT u.program_id, u.name, CASE WHEN exp.name IS NOT NULL THEN 'm' || u.program_id || '.' || u.name WHEN sym.owner IS NOT NULL THEN 'm' || sym.owner || '.' || u.name ELSE u.name END AS meant
  FROM (SELECT DISTINCT program_id, var AS name FROM ins WHERE opcode IN ('LOAD_VAR', 'STORE_VAR')) u JOIN md USING (program_id)
  LEFT JOIN exp ON exp.program_id = u.program_id AND exp.name = u.name LEFT JOIN sym ON sym.project = md.project AND sym.name = u.name)"""))
def linked_instructions(spark, sf) -> DataFrame:
    """Places, registers, names and labels of the linked projects."""
    return _linked(spark, sf).select("project", "pc", "program_id", "opcode", "result_reg", F.array_join("operands", " ").alias("operands"), "label")


@query("rl07_linked_edges", derived.oracle("""
SELECT mb.project, a.new AS src, b.new AS dst FROM edge e JOIN mb USING (program_id) JOIN lb a ON a.program_id = e.program_id AND a.label = e.src JOIN lb b ON b.program_id = e.program_id AND b.label = e.dst
UNION SELECT mb.project, 'm' || program_id, lb.new FROM lb JOIN mb USING (program_id) WHERE lb.block_ord = 0 AND lb.is_func
UNION SELECT mb.project, lb.new, 'm' || mb.following FROM lb JOIN mb USING (program_id) WHERE lb.is_last AND mb.following IS NOT NULL AND lb.last_op NOT IN ('BRANCH', 'BRANCH_IF', 'RETURN')""", _MODULES + """,
lb AS (SELECT blk.program_id, label, block_ord, is_func, last_op, block_ord = max(block_ord) OVER (PARTITION BY blk.program_id) AS is_last,
  CASE WHEN is_func THEN 'm' || blk.program_id || '.' || label WHEN block_ord = 0 THEN 'm' || blk.program_id ELSE '__block_' || (mb.start + first_pc + 1) END AS new FROM blk JOIN mb USING (program_id))"""))
def linked_edges(spark, sf) -> DataFrame:
    """The control flow of the linked projects, worked out anew from their instructions."""
    code = _linked(spark, sf).drop("program_id").withColumnRenamed("project", "program_id")
    return cfg.edges(cfg.blocks(cfg.placed(code))).select(F.col("program_id").alias("project"), "src", "dst")


#: From gn and ge: nodes on or above a circle, levels of the others, and places.
_ORDERED = """
clo AS (SELECT src, dst FROM ge UNION SELECT c.src, e.dst FROM clo c JOIN ge e ON e.src = c.dst),
circ AS (SELECT src AS node FROM clo WHERE src = dst),
bad AS (SELECT node FROM circ UNION SELECT clo.src FROM clo JOIN circ ON circ.node = clo.dst),
good AS (SELECT node FROM gn WHERE node NOT IN (SELECT node FROM bad)),
lv AS (SELECT node, 0 AS level FROM good UNION SELECT ge.src, lv.level + 1 FROM lv JOIN ge ON ge.dst = lv.node JOIN good ON good.node = ge.src),
ranked AS (SELECT node, max(level) AS level, FALSE AS cyclic FROM lv GROUP BY node UNION ALL SELECT node, NULL, TRUE FROM bad)
"""
_POSITIONS = "SELECT node, level, cyclic, row_number() OVER (ORDER BY cyclic, level, node) - 1 AS position FROM ranked"


@query("rg15_module_order", f"""WITH RECURSIVE ge AS (SELECT DISTINCT p_partkey AS src, p_partkey // d AS dst FROM part, (VALUES (2), (3)) x(d) WHERE p_partkey > 0
UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey % 250 = 140), gn AS (SELECT src AS node FROM ge UNION SELECT dst FROM ge), {_ORDERED} {_POSITIONS}""")
def module_order(spark, sf) -> DataFrame:
    """Parts as modules that need those of half and a third of their number, with circles planted: one order over all."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k)
    needs = p.where(k > 0).select(k.alias("src"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("dst"))
    edges = needs.union(p.where(k % 250 == 140).select(F.floor(k / 2), k))
    return order(edges.select(F.col("src").alias("node")), edges)


@query("rg15_link_order", f"WITH RECURSIVE {_LINKS}, {_ORDERED} {_POSITIONS}")
def link_order(spark, sf) -> DataFrame:
    """Linked names of pages, each after the names that follow it on a page; those on or above circles last."""
    links = page_links(spark, sf)
    edges = links.select(F.col("name").alias("src"), F.lead("name").over(Window.partitionBy("page_id").orderBy("at")).alias("dst")).where("dst is not null")
    return order(links.select(F.col("name").alias("node")), edges)


_SPANS = """sp AS (
  SELECT doc_id, k, CAST(97 * k - CASE WHEN k % 5 = 4 THEN 95 ELSE 0 END AS BIGINT) AS start, CAST(97 * k + k % 4 AS BIGINT) AS stop, '<' || k || '>' AS replacement
  FROM (SELECT doc_id, unnest(range(0, length(text) // 97 + 2)) AS k FROM documents WHERE text IS NOT NULL)
), ok AS (SELECT sp.*, length(text) AS size, text FROM sp JOIN documents USING (doc_id) WHERE stop <= length(text)),
judged AS (SELECT *, coalesce(start < max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop, replacement ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS crossed FROM ok),
kept AS (SELECT *, coalesce(lag(stop) OVER w, 0) AS before, row_number() OVER w AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM judged WHERE NOT crossed WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop, replacement)),
made AS (SELECT doc_id, string_agg(substr(text, before + 1, start - before) || replacement || CASE WHEN nth = n THEN substr(text, stop + 1) ELSE '' END, '' ORDER BY nth) AS text, count(*) AS kept FROM kept GROUP BY doc_id)"""


def _spans(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the documents, and a replacement at every 97th character; one of five reaches back over the one before, the last ones over the end."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    k = F.col("k")
    spans = texts.where("text is not null").select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("text") / 97) + 1)).alias("k"))
    return texts, spans.select("id", (97 * k - F.when(k % 5 == 4, 95).otherwise(0)).alias("start"), (97 * k + k % 4).alias("stop"), F.concat(F.lit("<"), k.cast("string"), F.lit(">")).alias("replacement"))


@query("rs16_patched_texts", f"""WITH {_SPANS} SELECT doc_id, coalesce(made.kept, 0) AS kept, coalesce((SELECT count(*) FROM sp WHERE sp.doc_id = d.doc_id), 0) - coalesce(made.kept, 0) AS refused, sha256(coalesce(made.text, d.text)) AS text_sha256
FROM documents d LEFT JOIN made USING (doc_id)""")
def patched_texts(spark, sf) -> DataFrame:
    """Many replacements in every document, applied at once."""
    return patching.patched(*_spans(spark, sf)).select(F.col("id").alias("doc_id"), "kept", "refused", F.sha2("text", 256).alias("text_sha256"))


_PATHS = r"""pp AS (SELECT page_id, list_concat(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS path FROM pages),
pre AS (SELECT DISTINCT path[1:k] AS path FROM (SELECT path, unnest(range(1, len(path) + 1)) AS k FROM pp)),
mk AS (SELECT DISTINCT path[1:1 + page_id % 4] AS path FROM pp WHERE page_id % 3 = 0)"""
_BEST = "(SELECT arg_max(array_to_string(m.path, '/'), len(m.path)) FROM mk m WHERE m.path = x.path[1:len(m.path)])"


def _page_paths(spark, sf) -> DataFrame:
    """(id, path): the labels of each page's host from the last to the first, then the segments of its path."""
    host, path = (F.regexp_extract("url", p, 1) for p in (r"://([^/?#]*)", r"://[^/?#]*([^?#]*)"))
    segments = F.concat(F.reverse(F.split(host, r"\.")), F.filter(F.split(path, "/"), lambda x: x != ""))
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), segments.alias("path"))


def _path_trie(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(paths, trie, marked nodes, names of nodes): beginnings of every third page's path are marked as roots."""
    paths = fixpoint.checkpointed(_page_paths(spark, sf))
    nodes = fixpoint.checkpointed(trie.build(paths))
    roots = paths.where("id % 3 = 0").select(F.expr("slice(path, 1, 1 + cast(id % 4 as int))").alias("path"))
    starts = fixpoint.checkpointed(trie.places(nodes, roots))
    return paths, nodes, starts.select("node"), starts.select("node", F.array_join("path", "/").alias("text"))


@query("rl12_longest_roots", f"WITH {_PATHS} SELECT page_id, {_BEST} AS root FROM pp x")
def longest_roots(spark, sf) -> DataFrame:
    """The longest marked beginning of each page's path."""
    paths, nodes, marked, names = _path_trie(spark, sf)
    best = trie.longest_prefix(nodes, marked, paths).select(F.col("id").alias("page_id"), "node")
    return best.join(names, "node", "left").select("page_id", F.col("text").alias("root"))


@query("rl11_namespace_tree", f"WITH {_PATHS} SELECT len(path) AS depth, path[len(path)] AS segment, {_BEST} AS root, count(*) AS n FROM pre x GROUP BY ALL")
def namespace_tree(spark, sf) -> DataFrame:
    """Every name of the tree of paths with the nearest marked name at or above it."""
    _, nodes, marked, names = _path_trie(spark, sf)
    near = trie.nearest_marked(nodes, marked).select("node", F.col("root").alias("rn"))
    named = nodes.where("depth > 0").join(near, "node").join(names.withColumnRenamed("node", "rn"), "rn", "left")
    return named.groupBy(F.col("depth").cast("long").alias("depth"), "segment", F.col("text").alias("root")).agg(F.count(F.lit(1)).alias("n"))
