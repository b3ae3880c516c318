"""Retrieval and index-maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakelake.functions import text as X
from quakelake.functions import vectors as V
from quakelake.operators import index as I
from quakelake.operators import retrieval as R
from quakelake.plans.inputs import table
from quakelake.plans.registry import query, rounded
from quakelake.plans.text_plans import document_chunks, _CHUNKS

_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+|[一-鿿㐀-䶿]+'), lambda t: length(t) > 1)"

_TFIDF = f"""WITH tok AS (SELECT doc_id, {_TOKENS.format('text')} AS ts FROM documents),
tf AS (SELECT doc_id, len(ts) AS n_tokens, unnest(ts) AS term FROM tok),
cnt AS (SELECT doc_id, n_tokens, term, count(*) AS tf FROM tf GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)) AS idf FROM cnt GROUP BY term),
raw AS (SELECT c.doc_id, c.term, c.tf, i.df, i.idf, c.tf / CAST(c.n_tokens AS DOUBLE) * i.idf AS w FROM cnt c JOIN idf i ON i.term = c.term),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM raw GROUP BY doc_id),
wt AS (SELECT raw.doc_id, term, tf, df, idf, CASE WHEN len > 0 THEN w / len ELSE w END AS weight FROM raw JOIN nrm ON nrm.doc_id = raw.doc_id)
"""


def benchmark_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("tfidf_weights", _TFIDF + "SELECT doc_id, term, tf, df, round(idf, 9) AS idf, round(weight, 9) AS weight FROM wt")
def tfidf_weights(spark, d):
    return rounded(R.tfidf_weights(table(spark, d, "documents")), 9, "idf", "weight")


_TFIDF_SEARCH = (
    _TFIDF
    + f""", q AS (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark),
qt AS (SELECT query_id, q.term, count(*) * any_value(idf) AS qw FROM q JOIN idf ON idf.term = q.term GROUP BY ALL),
ql AS (SELECT query_id, sqrt(sum(qw * qw)) AS qlen FROM qt GROUP BY query_id),
dt AS (SELECT query_id, doc_id, sum(qw * weight) AS dot FROM qt JOIN wt ON wt.term = qt.term WHERE weight > 0 GROUP BY ALL),
sc AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(round(dot / qlen, 9), 0) AS score FROM benchmark b CROSS JOIN documents d
       LEFT JOIN dt ON dt.query_id = b.item_id AND dt.doc_id = d.doc_id LEFT JOIN ql ON ql.query_id = b.item_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
"""
)


@query("tfidf_search", _TFIDF_SEARCH + "SELECT query_id, rank, doc_id, score FROM rk WHERE rank <= 5")
def tfidf_search(spark, d):
    return R.tfidf_search(table(spark, d, "documents"), benchmark_queries(spark, d), 5)


def _query_vectors(spark, d):
    """Every seventh label starts a query: queries grow with the table."""
    return table(spark, d, "embeddings").filter("label = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )


_VEC = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS len FROM v),
sc AS (SELECT q.vec_id AS query_id, u.vec_id AS chunk_id, round(list_dot_product(q.e, u.e) / (q.len * u.len), 9) AS score
       FROM u AS q, u WHERE q.label = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)
"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@query("vector_topk", _VEC + "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 8")
def vector_topk(spark, d):
    return rounded(R.vector_topk(_vectors(spark, d), _query_vectors(spark, d), 8), 6, "score")


@query("vector_topk_blocks", _VEC + "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 8")
def vector_topk_blocks(spark, d):
    """The same search by query and vector blocks, as for a batch too large to send to every task."""
    got = R.vector_topk(_vectors(spark, d), _query_vectors(spark, d), 8, small_values=640, vectors_per_cell=100)
    return rounded(got, 6, "score")


@query(
    "vector_threshold_display",
    _VEC
    + """SELECT query_id, rank, chunk_id, e.label + 1 AS page, round(score, 4) AS score FROM rk JOIN embeddings e ON e.vec_id = chunk_id
WHERE rank <= 8 AND score >= 0.3""",
)
def vector_threshold_display(spark, d):
    hits = R.vector_topk(_vectors(spark, d), _query_vectors(spark, d), 8)
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("page"))
    return R.for_display(R.with_chunks(hits, chunks, threshold=0.3)).select("query_id", "rank", "chunk_id", "page", "score")


@query(
    "multi_query_union",
    _VEC
    + """, h AS (SELECT query_id, chunk_id, score, query_id % 5 AS question FROM rk WHERE rank <= 8 AND score >= 0.2),
f AS (SELECT *, row_number() OVER (PARTITION BY question, chunk_id ORDER BY query_id) AS r FROM h)
SELECT question, chunk_id, query_id AS query_no, round(score, 6) AS score FROM f WHERE r = 1""",
)
def multi_query_union(spark, d):
    """Queries are grouped five ways into questions; the first query of a question wins a chunk."""
    hits = R.vector_topk(_vectors(spark, d), _query_vectors(spark, d), 8).filter(F.col("score") >= 0.2)
    hits = hits.select((F.col("query_id") % 5).alias("question"), F.col("query_id").alias("query_no"), "chunk_id", "score")
    return rounded(R.first_query_wins(hits, ["question"]), 6, "score")


@query(
    "seen_exclusion",
    _VEC
    + """SELECT query_id, rank, chunk_id FROM rk WHERE rank <= 8 AND query_id % 2 = 1
  AND chunk_id NOT IN (SELECT chunk_id FROM rk WHERE rank <= 8 AND query_id % 2 = 0)""",
)
def seen_exclusion(spark, d):
    """Round one asks the even queries; round two keeps only chunks it did not return."""
    hits = R.vector_topk(_vectors(spark, d), _query_vectors(spark, d), 8)
    return R.unseen(hits.filter("query_id % 2 = 1"), hits.filter("query_id % 2 = 0")).select("query_id", "rank", "chunk_id")


@query(
    "unit_vectors",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v)
SELECT vec_id, round(len, 9) AS norm, round(list_sum(list_transform(e, lambda x: x / len)), 8) AS component_sum FROM n""",
)
def unit_vectors(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.round(V.norm(e), 9).alias("norm"),
        F.round(F.aggregate(V.unit(e), F.lit(0.0), lambda a, x: a + x), 8).alias("component_sum"),
    )


@query(
    "mean_pool",
    """WITH c AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 4 <> 0),
m AS (SELECT label, i, avg(x) AS x FROM c GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) AS len FROM m GROUP BY label)
SELECT m.label, count(*) AS dim, round(sum(x / len), 7) AS component_sum FROM m JOIN n ON n.label = m.label GROUP BY m.label""",
)
def mean_pool(spark, d):
    tokens = table(spark, d, "embeddings").select(
        "label", F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 4 == 0, 0).otherwise(1).alias("mask")
    )
    pooled = R.mean_pool(tokens, "label")
    return pooled.select(
        "label",
        F.size("vector").cast("long").alias("dim"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 7).alias("component_sum"),
    )


@query(
    "hashed_vectors",
    f"""WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS t FROM documents),
c AS (SELECT doc_id, CAST('0x' || substring(md5(t), 1, 8) AS BIGINT) % 256 AS component, count(*) AS n FROM t GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM c GROUP BY doc_id)
SELECT c.doc_id, component, round(n / len, 9) AS weight FROM c JOIN l ON l.doc_id = c.doc_id""",
)
def hashed_vectors(spark, d):
    return rounded(R.hashed_vectors(table(spark, d, "documents")), 9, "weight")


@query("embedded_messages")
def embedded_messages(spark, d):
    """A user-supplied encoder (letter counts) run in batches."""
    import numpy as np

    def encode(texts):
        return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=float)

    return R.embed(table(spark, d, "conversations"), encode).select("conv_id", "turn", "embedding")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[ \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+'), lambda w: w <> ''))"


@query(
    "overlap_top4",
    f"""WITH q AS (SELECT item_id AS query_id, {_WORDS.format('text')} AS w FROM benchmark),
c AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents),
u AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM q),
s AS (SELECT query_id, doc_id, count(*) / (any_value(n) + 1e0) AS score FROM u JOIN c ON c.word = u.word GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, round(score, 9) AS score FROM r WHERE rank <= 4""",
)
def overlap_top4(spark, d):
    got = R.overlap_topk(table(spark, d, "documents"), benchmark_queries(spark, d), 4, "doc_id")
    return rounded(got, 9, "score")


def skill_catalog(spark, d):
    """Benchmark items as catalog entries: keywords from the first words, body the whole text."""
    words = F.slice(F.array_distinct(R.X.tokens(F.col("text"))), 1, 4)
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("Skill_"), F.lpad(F.col("item_id").cast("string"), 5, "0")).alias("name"),
        F.element_at(F.split("text", "[.] "), 1).alias("description"),
        F.concat_ws(" ", F.element_at(F.split("text", " "), 1), F.lit("topic")).alias("title"),
        words.alias("keywords"),
        F.col("text").alias("body"),
        F.when(F.col("item_id") % 3 == 0, "user").when(F.col("item_id") % 3 == 1, "builtin").otherwise("generated").alias("source"),
        (F.col("item_id") % 5).alias("folder"),
    )


# First four distinct tokens: group by token, keep the earliest position.
_CATALOG = f"""WITH tk AS (SELECT item_id, unnest({_TOKENS.format('text')}) AS t, generate_subscripts({_TOKENS.format('text')}, 1) AS pos FROM benchmark),
fd AS (SELECT item_id, t, min(pos) AS pos FROM tk GROUP BY item_id, t),
kw AS (SELECT item_id, list(t ORDER BY pos)[1:4] AS keywords FROM fd GROUP BY item_id),
cat AS (SELECT 'Skill_' || lpad(CAST(b.item_id AS VARCHAR), 5, '0') AS name, string_split(text, '. ')[1] AS description,
               string_split(text, ' ')[1] || ' topic' AS title, coalesce(keywords, CAST([] AS VARCHAR[])) AS keywords, text AS body,
               CASE b.item_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'builtin' ELSE 'generated' END AS source
        FROM benchmark b LEFT JOIN kw ON kw.item_id = b.item_id),
msg AS (SELECT conv_id * 100 + turn AS query_id, lower(text) AS q,
               list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_\\-\\.]+'), lambda w: lower(w))) AS toks FROM conversations),
kp AS (SELECT query_id, name, title, description, body, source, q, toks,
         coalesce(list_sum(list_transform(keywords, lambda k: CASE WHEN contains(q, lower(k)) THEN 5
           WHEN len(list_filter(toks, lambda t: length(t) >= 2 AND contains(lower(k), t))) > 0 THEN 3 ELSE 0 END)), 0)
         + CASE WHEN contains(q, lower(name)) OR len(list_filter(toks, lambda t: length(t) >= 2 AND contains(lower(name), t))) > 0 THEN 2 ELSE 0 END AS p
       FROM msg, cat)
"""


def _messages(spark, d):
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query")
    )


@query(
    "field_score",
    _CATALOG
    + """, s AS (SELECT query_id, name, source, p
    + CASE WHEN len(list_filter(toks, lambda t: length(t) >= 3 AND contains(lower(description), t))) > 0 THEN 2 ELSE 0 END
    + least(3, len(list_filter(toks, lambda t: length(t) >= 3 AND contains(lower(body), t)))) AS s FROM kp),
u AS (SELECT query_id, name, CAST(s + CASE WHEN source = 'user' AND s > 0 THEN 1 ELSE 0 END AS BIGINT) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM u WHERE score > 0)
SELECT query_id, rank, name, score FROM r WHERE rank <= 3""",
)
def field_score(spark, d):
    cat = R.lower_fields(skill_catalog(spark, d), "keywords", "description", "body").select(
        "name", "description", "keywords", "body", "source"
    )
    return R.field_topk(cat, _messages(spark, d), R.entry_score, 3)


@query(
    "workflow_score",
    _CATALOG
    + """, s AS (SELECT query_id, name, source, p
    + CASE WHEN len(list_filter(toks, lambda t: length(t) >= 3 AND contains(lower(title), t))) > 0 THEN 1 ELSE 0 END
    + len(list_filter(toks, lambda t: length(t) >= 3 AND contains(lower(description), t))) AS s FROM kp),
u AS (SELECT query_id, name, CAST(s + CASE WHEN source = 'user' AND s > 0 THEN 1 ELSE 0 END AS BIGINT) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM u WHERE score > 0)
SELECT query_id, rank, name, score FROM r WHERE rank <= 2""",
)
def workflow_score(spark, d):
    cat = R.lower_fields(skill_catalog(spark, d), "keywords", "title", "description").select(
        "name", "title", "description", "keywords", "source"
    )
    return R.field_topk(cat, _messages(spark, d), R.workflow_score, 2)


@query(
    "reference_score",
    """WITH ref AS (SELECT item_id AS ref_id, string_split(replace('the-' || string_split(lower(text), ' ')[1], '_', '-'), '-') AS parts,
    list_transform(list_filter(string_split('# ' || text, chr(10)), lambda x: starts_with(x, '#')), lambda x: lower(trim(ltrim(x, '#')))) AS headings,
    lower('# ' || text) AS opening FROM benchmark),
msg AS (SELECT conv_id * 100 + turn AS query_id, lower(text) AS q,
               list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_\\-\\.]+'), lambda w: lower(w))) AS toks FROM conversations),
s AS (SELECT query_id, ref_id, CAST(6 * len(list_filter(list_distinct(parts), lambda p: length(p) >= 3 AND contains(q, p)))
   + 3 * coalesce(list_sum(list_transform(headings, lambda h: len(list_filter(toks, lambda t: length(t) >= 3 AND contains(h, t))))), 0)
   + len(list_filter(toks, lambda t: length(t) >= 3 AND contains(opening, t))) AS BIGINT) AS score FROM msg, ref),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM s WHERE score >= 1)
SELECT query_id, rank, ref_id, score FROM r WHERE rank <= 3""",
)
def reference_score(spark, d):
    refs = table(spark, d, "benchmark").select(
        F.col("item_id").alias("ref_id"),
        F.concat(F.lit("the-"), F.element_at(F.split("text", " "), 1)).alias("ref_name"),
        F.concat(F.lit("# "), "text").alias("text"),
    )
    return R.field_topk(R.reference_fields(refs), _messages(spark, d), R.reference_score, 3, entry_id="ref_id")


_PASSAGES = _TFIDF_SEARCH + """, hit AS (SELECT query_id, rank, rk.doc_id, score, '[Source: ' || source || ', section 1, relevance ' || printf('%.2f', round(score, 4)) || ']' || chr(10) || text || chr(10) AS entry
   FROM rk JOIN documents d ON d.doc_id = rk.doc_id WHERE rank <= 5),
run AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM hit)
"""


def _passages(spark, d):
    docs = table(spark, d, "documents")
    hits = R.tfidf_search(docs, benchmark_queries(spark, d), 5)
    texts = docs.select("doc_id", "source", "text")
    entry = R.passage(F.col("source"), F.lit(0), F.round("score", 4), F.col("text"))
    return R.with_chunks(hits, texts, "doc_id").select("query_id", "rank", "doc_id", entry.alias("entry"))


@query("budget_pack", _PASSAGES + "SELECT query_id, rank, doc_id, entry, CAST(total AS BIGINT) AS total FROM run WHERE total <= 6000")
def budget_pack(spark, d):
    return R.budget_pack(_passages(spark, d), ["query_id"], "rank", "entry", 6000)


@query(
    "budget_pack_cut",
    _PASSAGES
    + """, c AS (SELECT *, 6000 - (total - length(entry)) - 20 AS left_ FROM run)
SELECT query_id, rank, doc_id, total > 6000 AS cut, CASE WHEN total <= 6000 THEN entry ELSE substring(entry, 1, CAST(left_ AS BIGINT)) || chr(10) || '…' || chr(10) END AS entry
FROM c WHERE total <= 6000 OR (total - length(entry) <= 6000 AND left_ > 200)""",
)
def budget_pack_cut(spark, d):
    got = R.budget_pack_cut(_passages(spark, d), ["query_id"], "rank", "entry", 6000)
    return got.select("query_id", "rank", "doc_id", "cut", "entry")


@query(
    "rag_context",
    _PASSAGES
    + """SELECT query_id, 'Passages:' || chr(10) || string_agg(entry, chr(10) ORDER BY rank) AS context FROM run WHERE total <= 6000 GROUP BY query_id""",
)
def rag_context(spark, d):
    packed = R.budget_pack(_passages(spark, d), ["query_id"], "rank", "entry", 6000)
    return R.joined_context(packed, ["query_id"], "rank", "entry", "Passages:\n")


# --- related entries ----------------------------------------------------------------------------


@query(
    "related_expand",
    """WITH cat AS (SELECT p_partkey AS id, 'p' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS name,
    ['p' || lpad(CAST((p_partkey * 7) % (SELECT count(*) FROM part) + 1 AS VARCHAR), 8, '0'), 'p' || lpad(CAST((p_partkey * 3) % (SELECT count(*) FROM part) + 1 AS VARCHAR), 8, '0')] AS rel FROM part),
l AS (SELECT name AS src, generate_subscripts(rel, 1) - 1 AS pos, unnest(rel) AS dst FROM cat),
hit AS (SELECT p_size AS query_id, name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rank
        FROM part JOIN cat ON cat.id = part.p_partkey),
h AS (SELECT * FROM hit WHERE rank <= 3),
e AS (SELECT src AS name, 0 AS side, pos AS k1, '' AS k2, dst AS other FROM l UNION ALL SELECT dst, 1, 0, src, src FROM l),
f AS (SELECT query_id, e.other AS name, rank, side, k1, k2 FROM h JOIN e ON e.name = h.name
      WHERE e.other IN (SELECT name FROM cat) AND NOT EXISTS (SELECT 1 FROM h h2 WHERE h2.query_id = h.query_id AND h2.name = e.other)),
g AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id, name ORDER BY rank, side, k1, k2) AS r, rank, side, k1, k2 FROM f),
x AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY rank, side, k1, k2) AS n FROM g WHERE r = 1)
SELECT query_id, rank, name, false AS extra FROM h
UNION ALL SELECT x.query_id, (SELECT max(rank) FROM h WHERE h.query_id = x.query_id) + n, name, true FROM x WHERE n <= 3""",
)
def related_expand(spark, d):
    part = table(spark, d, "part")
    n = part.agg(F.count("*").alias("n")).scalar()
    name = lambda i: F.concat(F.lit("p"), F.lpad(i.cast("string"), 8, "0"))
    key = F.col("p_partkey")
    catalog = part.select(name(key).alias("name"), F.array(name(key * 7 % n + 1), name(key * 3 % n + 1)).alias("related"))
    from quakelake.operators.common import top_k

    hits = top_k(part.select(F.col("p_size").alias("query_id"), key, name(key).alias("name")), ["query_id"], [F.asc("p_partkey")], 3)
    return R.related_entries(hits.select("query_id", "rank", "name"), catalog)


@query(
    "related_by_keywords",
    _CATALOG.split("msg AS")[0].rstrip().rstrip(",")
    + f""", w AS (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS kw FROM documents),
o AS (SELECT name, lower(unnest(keywords)) AS kw FROM cat WHERE source <> 'generated'),
c AS (SELECT doc_id, name, count(*) AS overlap FROM w JOIN o ON o.kw = w.kw GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, name DESC) AS rank FROM c)
SELECT doc_id, rank, name, overlap FROM r WHERE rank <= 3""",
)
def related_by_keywords(spark, d):
    entries = table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("keywords"))
    return R.related_by_keywords(entries, skill_catalog(spark, d))


# --- index maintenance --------------------------------------------------------------------------

_EXT = "CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' WHEN 3 THEN '.html' ELSE '.exe' END"
_REL = f"CASE WHEN doc_id % 13 = 0 THEN '' ELSE source || '/' || CASE WHEN doc_id % 2 = 0 THEN 'deep/' ELSE '' END END || CASE WHEN doc_id % 37 = 0 THEN 'README.md' WHEN doc_id % 41 = 0 THEN '.hidden.md' ELSE 'f' || doc_id || {_EXT} END"


def _rel_path():
    i = F.col("doc_id")
    ext = F.when(i % 5 == 0, ".md").when(i % 5 == 1, ".txt").when(i % 5 == 2, ".pdf").when(i % 5 == 3, ".html").otherwise(".exe")
    name = F.when(i % 37 == 0, "README.md").when(i % 41 == 0, ".hidden.md").otherwise(F.concat(F.lit("f"), i.cast("string"), ext))
    folder = F.when(i % 13 == 0, "").otherwise(F.concat("source", F.lit("/"), F.when(i % 2 == 0, "deep/").otherwise("")))
    return F.concat(folder, name)


@query(
    "key_files",
    f"""WITH f AS (SELECT doc_id, {_REL} AS rel_path FROM documents),
b AS (SELECT *, string_split(rel_path, '/')[-1] AS base FROM f),
e AS (SELECT *, lower(regexp_extract(rel_path, '[^/](\\.[^./]+)$', 1)) AS ext FROM b),
s AS (SELECT *, CASE WHEN contains(rel_path, '/') THEN string_split(rel_path, '/')[1] ELSE '' END AS project FROM e
      WHERE ext IN ('.pdf', '.docx', '.md', '.txt', '.text', '.rst', '.html', '.htm') AND NOT starts_with(base, '.')),
p AS (SELECT *, CASE WHEN lower(base) IN ('readme.md', 'index.md') THEN 0 WHEN ext = '.md' THEN 1 WHEN ext = '.txt' THEN 2 WHEN ext = '.pdf' THEN 3 ELSE 5 END AS tier,
             len(string_split(rel_path, '/')) AS depth FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY tier, depth, rel_path, doc_id) AS r FROM p)
SELECT rel_path, project FROM r WHERE project = '' OR r <= 10""",
)
def key_files(spark, d):
    listing = table(spark, d, "documents").select(_rel_path().alias("rel_path"))
    return I.key_files(listing, max_files=10)


def _listing(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").filter(i % 17 != 0).select(
        F.concat("source", F.lit("/"), i.cast("string"), F.lit(".txt")).alias("rel_path"),
        (F.lit(1.7e9) + i + F.when(i % 19 == 0, 5.0).otherwise(0.25)).alias("mtime"),
        (F.length("text") + F.when(i % 23 == 0, 1).otherwise(0)).cast("long").alias("size"),
        I.fingerprint(F.encode(F.concat("text", F.when(i % 29 == 0, "!").otherwise("")), "UTF-8")).alias("sha256"),
    )


def _manifest(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").filter(i % 7 != 0).select(
        F.concat("source", F.lit("/"), i.cast("string"), F.lit(".txt")).alias("rel_path"),
        (F.lit(1.7e9) + i).alias("mtime"),
        F.length("text").cast("long").alias("size"),
        I.fingerprint(F.encode("text", "UTF-8")).alias("sha256"),
        F.when(i % 11 == 0, "failed").when(i % 31 == 0, "queued").otherwise("indexed").alias("status"),
        F.concat(F.lit("d"), i.cast("string")).alias("doc_id"),
        F.col("source").alias("proj_folder"),
    )


def _live(spark, d):
    return table(spark, d, "documents").filter("doc_id % 5 <> 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"))


# The SQL twin compares the change directly, without hashes.
_DIFF = """WITH dl AS (SELECT doc_id AS i, source || '/' || doc_id || '.txt' AS rel_path, text FROM documents),
st AS (SELECT i, rel_path, CASE
   WHEN i % 17 = 0 AND i % 7 = 0 THEN NULL WHEN i % 17 = 0 THEN 'deleted' WHEN i % 7 = 0 THEN 'new' WHEN i % 11 = 0 THEN 'failed' WHEN i % 31 = 0 THEN 'new'
   WHEN i % 19 = 0 OR i % 23 = 0 OR i % 29 = 0 THEN 'modified' WHEN i % 5 = 0 THEN 'new' ELSE 'unchanged' END AS state FROM dl)
"""


@query("manifest_diff", _DIFF + "SELECT rel_path, CASE WHEN i % 7 = 0 THEN NULL ELSE 'd' || i END AS doc_id, state FROM st WHERE state IS NOT NULL")
def manifest_diff(spark, d):
    return I.manifest_diff(_listing(spark, d), _manifest(spark, d), _live(spark, d))


@query("pending_files", _DIFF + "SELECT rel_path, state FROM st WHERE state IN ('new', 'modified', 'failed')")
def pending_files(spark, d):
    return I.pending(manifest_diff(spark, d)).select("rel_path", "state")


@query(
    "changed_projects",
    _DIFF
    + """, p AS (SELECT string_split(rel_path, '/')[1] AS project, count(*) FILTER (WHERE state <> 'unchanged') AS n_pending FROM st
   WHERE state IS NOT NULL AND state <> 'deleted' GROUP BY 1)
SELECT project, CASE WHEN project IN ('src1', 'src2') THEN 'updated' ELSE 'new' END AS state, n_pending FROM p WHERE project NOT IN ('src1', 'src2') OR n_pending > 0""",
)
def changed_projects(spark, d):
    known = table(spark, d, "documents").filter(F.col("source").isin("src1", "src2")).select(F.col("source").alias("project"))
    return I.changed_projects(manifest_diff(spark, d), known)


@query(
    "project_status",
    _DIFF
    + """, s AS (SELECT i, string_split(rel_path, '/')[1] AS project, state, CASE WHEN i % 7 = 0 THEN NULL WHEN i % 11 = 0 THEN 'failed' WHEN i % 31 = 0 THEN 'queued' ELSE 'indexed' END AS s
   FROM st WHERE i % 17 <> 0),
c AS (SELECT project, count(*) AS n_files, count(*) FILTER (WHERE s = 'indexed') AS n_indexed, count(*) FILTER (WHERE s = 'failed') AS n_failed,
   count(*) FILTER (WHERE state IN ('new', 'modified')) AS n_changed FROM s GROUP BY project)
SELECT project, n_files, n_indexed, n_failed, CASE WHEN n_indexed = 0 THEN 'new' WHEN n_changed > 0 THEN 'modified' WHEN n_indexed < n_files THEN 'partial' ELSE 'indexed' END AS status FROM c""",
)
def project_status(spark, d):
    return I.project_status(_listing(spark, d), manifest_diff(spark, d), _manifest(spark, d))


@query(
    "content_fingerprint",
    "SELECT doc_id, sha256(text) AS sha256 FROM documents",
)
def content_fingerprint(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", I.fingerprint(F.encode("text", "UTF-8")).alias("sha256"))


@query(
    "doc_dedup",
    """WITH k AS (SELECT substring(md5(source || '/' || lang || '|' || text), 1, 12) AS doc_id, doc_id AS added, source FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY added) AS r FROM k WHERE added % 4 <> 0)
SELECT doc_id, added, source FROM f WHERE r = 1 AND doc_id NOT IN (SELECT doc_id FROM k WHERE added % 4 = 0)""",
)
def doc_dedup(spark, d):
    """Three quarters of the documents arrive at a store that holds the rest."""
    keyed = table(spark, d, "documents").select(
        I.document_id(F.col("source"), F.col("lang"), F.encode("text", "UTF-8")).alias("doc_id"),
        F.col("doc_id").alias("added"),
        "source",
    )
    return I.new_documents(keyed.filter("added % 4 <> 0"), keyed.filter("added % 4 = 0"), "added")


@query(
    "delete_cascade",
    _CHUNKS + "SELECT chunk_id, doc_id FROM chunk WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def delete_cascade(spark, d):
    docs = table(spark, d, "documents")
    gone = table(spark, d, "labels").filter("toxic = 1")
    return I.delete_documents(docs, document_chunks(spark, d), gone)[1].select("chunk_id", "doc_id")


@query(
    "delete_project",
    _CHUNKS + "SELECT chunk_id FROM chunk WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3' AND doc_id % 7 <> 0)",
)
def delete_project(spark, d):
    manifest = _manifest(spark, d).withColumn("doc_id", F.substring("doc_id", 2, 20).cast("long"))
    return I.delete_project(manifest, table(spark, d, "documents"), document_chunks(spark, d), "src3")[2].select("chunk_id")


@query(
    "evict_missing",
    """SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id IN (SELECT doc_id FROM labels)""",
)
def evict_missing(spark, d):
    path = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(path).alias("file_path"))
    files = table(spark, d, "labels").select(path.alias("path"))
    return I.evict_missing(docs, document_chunks(spark, d), files)[0].select("doc_id")


@query(
    "override_union",
    """SELECT p_partkey AS name, CASE WHEN p_size > 25 THEN 'user' ELSE 'builtin' END AS source, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS description FROM part""",
)
def override_union(spark, d):
    part = table(spark, d, "part")
    builtin = part.select(F.col("p_partkey").alias("name"), F.lit("builtin").alias("source"), F.col("p_type").alias("description"))
    user = part.filter("p_size > 25").select(F.col("p_partkey").alias("name"), F.lit("user").alias("source"), F.col("p_brand").alias("description"))
    return I.override_union([builtin, user])


@query(
    "all_documents",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'primary' ELSE 'fallback' END AS store, n_chars AS added_at FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
)
def all_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("added_at"))
    primary = docs.filter("doc_id % 2 = 0").withColumn("store", F.lit("primary"))
    return I.all_documents(primary, docs.filter("doc_id % 3 = 0").withColumn("store", F.lit("fallback")))


@query(
    "catalog_listing",
    _CATALOG.split("msg AS")[0].rstrip().rstrip(",") + "SELECT name, description, array_to_string(keywords, ' ') AS keywords, source FROM cat",
)
def catalog_listing(spark, d):
    return I.catalog_listing(skill_catalog(spark, d)).withColumn("keywords", F.array_join("keywords", " "))
