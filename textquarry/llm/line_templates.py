"""Line dedup by log templates, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small, staged
from .registry import query, table
from .rows import fresh

LEADING = 3  # tokens that lead through the tree, below the token count
RECURS = 3  # documents
ALIKE = 0.5  # share of constant tokens after the leading ones
LONG = 50  # tokens above which an exact line recurs from two documents on
SHARES = (0.1, 0.5)  # of a leaf's lines, for a token that stays constant in wider templates
FIELD = "<*>"


def _tokens(line: Column) -> Column:
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))  # few lines need the slow translation
    spaced = F.when(odd, F.translate(line, "\t\r", "  ")).otherwise(line)
    return F.filter(F.split(spaced, " ", -1), lambda t: t != "")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _shape(line: Column, shortest: int, long: int | None) -> Column:
    """(leaf, big) of a line, cut into tokens once. The leaf is a hash of the token count and the
    leading tokens, which are not masked where no token comes after them; null for lines
    below ``shortest`` tokens. Big are lines of more than ``long`` tokens."""

    def of(tokens: Column) -> Column:
        lead = [F.get(tokens, F.lit(i)) for i in range(LEADING)]
        leading = [F.when(F.size(tokens) > LEADING, _masked(x)).otherwise(x) for x in lead]
        leaf = F.when(F.size(tokens) >= shortest, F.xxhash64(F.size(tokens), *leading))
        big = F.lit(False) if long is None else F.size(tokens) > long
        return F.struct(leaf.alias("leaf"), big.alias("big"))

    return F.transform(F.array(_tokens(line)), of)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dropped_lines(
    docs: DataFrame, recurs: int = RECURS, alike: float = ALIKE, shortest: int = 1, shares: tuple[float, ...] = SHARES,
    long: int | None = LONG,
) -> DataFrame:
    """(doc_id, text_hash, lines): for each row that loses lines the xxhash64 of these lines.

    Lines are parsed by a tree of fixed depth: the number of tokens (between spaces, tabs and
    carriage returns), then the LEADING first tokens, in which a token with a digit is a
    field. In a leaf, a token at a later place stays constant if it is there in at least
    ``recurs`` documents, counted per distinct line, and is a field otherwise. A line whose
    share of constant tokens after the leading ones is at least ``alike`` has the template of
    its tokens so masked. As a table grows, each value of a field comes to be in ``recurs``
    documents. So a line has a wider template for each of ``shares`` too, by the same rule, in
    which a constant token is also in this share of the leaf's lines; lines alike in a template
    are alike in all wider ones. Templates in at least ``recurs`` documents recur: their lines stay
    in the document with the smallest doc_id and are dropped from all others. So does an exact
    line of more than ``long`` tokens in two documents or more; None: only templates recur. A
    line without later tokens, which is also what a line without spaces is, has its own
    tokens as template. Lines of fewer than ``shortest`` tokens, or none, have no template.

    A row's document is its doc_id and text; rows that repeat both count as one, and of rows
    that repeat a doc_id all keep what one keeps. Null ids come first only among themselves.

    Only hashes of leaves leave the first scan. Lines of recurring leaves are folded by
    content before their tokens are counted, and all counts combine on the map side.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL")

    shape = lambda line: _shape(line, max(shortest, 1), long)
    leaves = rows.select(F.explode(F.array_distinct(F.transform(_lines(F.col("text")), shape))).alias("of"))
    leaves = leaves.select("of.*").where("leaf IS NOT NULL").groupBy("leaf", "big").agg(F.count(F.lit(1)).alias("n"))
    leaves = leaves.where((F.col("n") >= recurs) | (F.col("big") & (F.col("n") >= 2)))
    leaves = broadcast_if_small(staged(leaves.select("leaf", "big", (F.col("n") >= recurs).alias("many")), "leaves"))

    lines = rows.select("doc_id", "text_hash", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    lines = lines.withColumn("leaf", shape(F.col("line"))["leaf"]).join(leaves, "leaf")
    kept = staged(lines.withColumn("line_hash", F.xxhash64("line")), "lines")
    lines = kept.where("many").drop("many", "big").distinct()

    distinct = lines.groupBy("leaf", "line_hash", "line").agg(F.count(F.lit(1)).alias("n"))
    tokens = distinct.select("leaf", "line_hash", "n", F.posexplode(_tokens(F.col("line"))).alias("at", "token"))
    tokens = tokens.withColumn("token", _masked(F.col("token")))
    constant = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))
    constant = constant.where(F.col("n") >= recurs)
    if shares:
        constant = staged(constant, "constant")
        # All lines of a leaf have the same first token.
        totals = broadcast_if_small(constant.where(F.col("at") == 0).select("leaf", F.col("n").alias("of")))
        constant = constant.join(totals, "leaf")
    level = sum(((F.col("n") >= share * F.col("of")).cast("int") for share in shares), F.lit(0))
    constant = constant.select("leaf", "at", "token", level.alias("level"))
    marked = tokens.join(constant, ["leaf", "at", "token"], "left")
    later = F.col("at") >= LEADING
    levels = range(len(shares) + 1)
    fixed = [F.coalesce(F.col("level") >= k, F.lit(False)) for k in levels]
    shapes = marked.groupBy("leaf", "line_hash").agg(
        *[F.bit_xor(F.xxhash64("at", F.when(later & ~fixed[k], F.lit(FIELD)).otherwise(F.col("token")))).alias(f"shape{k}") for k in levels],
        *[F.count_if(later & fixed[k]).alias(f"same{k}") for k in levels],
        F.count_if(later).alias("later"),
    )
    shapes = shapes.where(F.col("same0") >= alike * F.col("later"))  # the wider have no more constants
    templates = [F.when(F.col(f"same{k}") >= alike * F.col("later"), F.xxhash64("leaf", f"shape{k}")) for k in levels]
    templates = F.filter(F.array_distinct(F.array(*templates)), lambda t: t.isNotNull())
    shapes = broadcast_if_small(staged(shapes.select("line_hash", templates.alias("templates")), "shapes"))

    used = lines.select("doc_id", "text_hash", "line_hash").join(shapes, "line_hash")
    used = used.select("doc_id", "text_hash", "line_hash", F.explode("templates").alias("template"))
    counts = used.select("template", "doc_id", "text_hash").distinct().groupBy("template").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")
    )
    counts = broadcast_if_small(staged(counts.where(F.col("n") >= recurs).select("template", "first"), "templates"))
    lost = used.join(counts, "template").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "line_hash")
    if long is not None:
        # From ``recurs`` documents on an exact line is a template of its own.
        big = kept.where("big").select("doc_id", "text_hash", "line_hash").distinct()
        twice = big.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
        twice = twice.where((F.col("n") >= 2) & (F.col("n") < recurs)).select("line_hash", "first")
        twice = broadcast_if_small(staged(twice, "twice"))
        again = big.join(twice, "line_hash").where(~F.col("doc_id").eqNullSafe(F.col("first")))
        lost = lost.unionByName(again.select("doc_id", "text_hash", "line_hash"))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("line_hash").alias("lines"))


def deduplicated_lines(
    docs: DataFrame, recurs: int = RECURS, alike: float = ALIKE, dropped: str | None = None, shortest: int = 1,
    shares: tuple[float, ...] = SHARES, long: int | None = LONG,
) -> DataFrame:
    """The rows of ``docs`` with their lines of recurring templates dropped, see
    :func:`dropped_lines`. ``text`` is what is left, joined by line breaks; null stays null.
    All other columns are as they were; ``dropped`` names a column to add that counts the
    lines dropped."""
    lost = broadcast_if_small(staged(dropped_lines(docs, recurs, alike, shortest, shares, long), "lost-lines"))
    lost_id, lost_hash, lost_lines = fresh(docs, "lost_id", "lost_hash", "lost_lines")
    lost = lost.toDF(lost_id, lost_hash, lost_lines)
    text = docs["text"].cast("string")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(lost_id)) & (F.xxhash64(text) == F.col(lost_hash))
    left = F.filter(_lines(text), lambda x: ~F.array_contains(F.col(lost_lines), F.xxhash64(x)))
    none = F.col(lost_lines).isNull()
    out = [
        F.when(none, text).otherwise(F.array_join(left, "\n")).alias("text") if c == "text" else docs[c]
        for c in docs.columns
    ]
    if dropped:
        gone = F.size(_lines(text)) - F.size(left)
        out.append(F.when(none, F.lit(0)).otherwise(gone).cast("long").alias(dropped))
    return docs.join(lost, same, "left").select(*out)


_SQL_TOKENS = "list_filter(string_split(translate(line, chr(9) || chr(13), '  '), ' '), lambda t: t <> '')"

_LEVELS = range(len(SHARES) + 1)
_SHAPES = ", ".join(
    f"""string_agg(CASE WHEN p.pos >= {LEADING} AND coalesce(g.level, -1) < {k} THEN '{FIELD}' ELSE p.token END, ' ' ORDER BY p.pos) AS shape{k},
    count(*) FILTER (p.pos >= {LEADING} AND g.level >= {k}) AS same{k}"""
    for k in _LEVELS
)
_TEMPLATES = ", ".join(f"CASE WHEN same{k} >= {ALIKE} * later THEN leaf || chr(10) || shape{k} END" for k in _LEVELS)

SQL = f"""WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, line, {_SQL_TOKENS} AS w FROM l),
k AS (SELECT doc_id, line, list_transform(w, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS m,
    len(w) AS size, w FROM t WHERE len(w) >= 1),
h AS (SELECT doc_id, line, m, size, array_to_string([CAST(size AS VARCHAR)] || CASE WHEN size > {LEADING} THEN m ELSE w END[1:{LEADING}], ' ') AS leaf
  FROM k),
f AS (SELECT leaf FROM h GROUP BY leaf HAVING count(DISTINCT doc_id) >= {RECURS}),
d AS (SELECT leaf, line, m, count(*) AS n FROM h WHERE leaf IN (FROM f) GROUP BY ALL),
p AS (SELECT leaf, line, n, unnest(m) AS token, unnest(range(len(m))) AS pos FROM d),
c AS (SELECT leaf, pos, token, sum(n) AS n FROM p GROUP BY ALL HAVING sum(n) >= {RECURS}),
g AS (SELECT c.leaf, c.pos, c.token, {" + ".join(f"CAST(c.n >= CAST({x} AS DOUBLE) * o.n AS INTEGER)" for x in SHARES)} AS level
  FROM c JOIN c o ON c.leaf = o.leaf AND o.pos = 0),
s AS (SELECT p.leaf, p.line, {_SHAPES}, count(*) FILTER (p.pos >= {LEADING}) AS later
  FROM p LEFT JOIN g ON p.leaf = g.leaf AND p.pos = g.pos AND p.token = g.token GROUP BY ALL),
q AS (SELECT DISTINCT line, unnest([{_TEMPLATES}]) AS template FROM s),
u AS (SELECT l.doc_id, l.line, q.template FROM l JOIN q ON l.line = q.line WHERE template IS NOT NULL),
r AS (SELECT template, min(doc_id) AS first FROM u GROUP BY template HAVING count(DISTINCT doc_id) >= {RECURS}),
b AS (SELECT line, min(doc_id) AS first FROM h WHERE size > {LONG} GROUP BY line HAVING count(DISTINCT doc_id) = 2),
x AS (SELECT DISTINCT u.doc_id, u.line FROM u JOIN r USING (template) WHERE u.doc_id <> r.first
  UNION SELECT h.doc_id, h.line FROM h JOIN b USING (line) WHERE h.doc_id <> b.first),
a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
y AS (SELECT a.doc_id, count(*) AS n_lines, count(x.line) AS n_dropped,
    coalesce(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (x.line IS NULL), '') AS kept
  FROM a LEFT JOIN x ON a.doc_id = x.doc_id AND a.line = x.line GROUP BY a.doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM y"""


@query("op2_line_templates", SQL)
def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents``, by the rules of :func:`dropped_lines` as the pipeline applies
    them; null texts are empty, and empty ones have one line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = docs.withColumn("n_lines", F.size(_lines(F.col("text"))).cast("long"))
    kept = deduplicated_lines(counted, dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
