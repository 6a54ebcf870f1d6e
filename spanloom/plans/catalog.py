"""Registered queries of the pattern engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import functions as S
from spanloom.engine import Engine
from spanloom.operators import closure, relational, results
from spanloom.operators.stats import corpus_stats
from spanloom.sources import adapters, reader, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEY = ["doc_id", "sentence_id", "sentence_idx"]

# SQL of the adapters: tokens with layers (tok), tree edges (dep), sentences (sent).


def _text_sql(lines: str) -> str:
    return f"""
lines AS ({lines}),
sent AS (SELECT doc_id::VARCHAR AS doc_id, doc_id::VARCHAR || '_' || sentence_idx AS sentence_id, sentence_idx::INT AS sentence_idx, word, len(word) AS n
  FROM (SELECT doc_id, sentence_idx, list_filter(string_split(line, ' '), lambda x: x <> '') AS word FROM lines) WHERE len(word) > 0),
raw AS (SELECT doc_id, sentence_id, sentence_idx, n, unnest(word) AS word, unnest(range(len(word)))::INT AS p FROM sent),
low AS (SELECT *, lower(word) AS norm, regexp_replace(lower(word), '[.,;:!?]+$', '') AS lemma FROM raw),
tagged AS (SELECT *, CASE WHEN regexp_matches(word, '^[0-9]') THEN 'CD' WHEN regexp_matches(word, '^[A-Z]') THEN 'UP'
  WHEN regexp_full_match(word, '[\\x00-\\x7F]*') AND NOT regexp_matches(word, '[A-Za-z0-9]') THEN 'PUNCT'
  WHEN ends_with(lemma, 'ing') THEN 'ING' ELSE 'LOW' END AS tag FROM low),
tok AS (SELECT *, CASE WHEN tag = 'UP' AND p > 0 THEN 'B-CAP' ELSE 'O' END AS entity FROM tagged),
dep AS (SELECT sentence_id, (p - 1) // 2 AS src, p AS dst, 'dep' || (p % 4) AS label FROM raw WHERE p >= 1)
"""


DOCS = _text_sql("SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS sentence_idx FROM documents")
CONVS = _text_sql("SELECT conv_id AS doc_id, turn AS sentence_idx, replace(text, chr(10), ' ') AS line FROM conversations")
EVENTS = """
raw AS (SELECT user_id::VARCHAR AS doc_id, user_id::VARCHAR || '_0' AS sentence_id, 0::INT AS sentence_idx, event_type AS word,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS p FROM events),
tok AS (SELECT * FROM raw)
"""
ORDERS = """
raw AS (SELECT o_orderkey::VARCHAR AS doc_id, o_orderkey::VARCHAR || '_0' AS sentence_id, 0::INT AS sentence_idx, 0::INT AS p, o_orderstatus AS word
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT l_orderkey::VARCHAR, l_orderkey::VARCHAR || '_0', 0::INT,
    (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag))::INT, l_returnflag
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
tok AS (SELECT * FROM raw),
dep AS (SELECT sentence_id, 0 AS src, p AS dst, lower(word) AS label FROM raw WHERE p > 0)
"""
_SPAN = "doc_id, sentence_id, sentence_idx"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None, base: str = DOCS, recursive: bool = False) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = f"WITH {'RECURSIVE ' * recursive}{base.strip()}{sql if sql.startswith(',') else ' ' + sql}"


def _engine(spark: SparkSession, sf_dir: str, adapter=adapters.documents, **options) -> Engine:
    return Engine(adapter(spark, sf_dir), **options)


def _spans(hits: DataFrame) -> DataFrame:
    return results.match_rows(hits).select(*KEY, F.col("start").alias("match_start"), F.col("end").alias("match_end"))


def spans(name: str, query: str, sql: str | None, adapter=adapters.documents, base: str = DOCS, overlap: str = "select", recursive: bool = False, **options) -> None:
    """A query whose result is one row a match."""
    add(name, lambda spark, sf_dir: _spans(_engine(spark, sf_dir, adapter, **options).hits(query, overlap)), sql, base, recursive)


def captures(name: str, query: str, sql: str) -> None:
    def run(spark, sf_dir):
        rows = results.capture_rows(_engine(spark, sf_dir).hits(query))
        return rows.select(*KEY, "match_start", "name", F.col("start").alias("capture_start"), F.col("end").alias("capture_end"))

    add(name, run, sql)


# Token predicates


def _tokens(where: str) -> str:
    return f"SELECT {_SPAN}, p AS match_start, p + 1 AS match_end FROM tok WHERE {where}"


spans("tok_wildcard", "[]", _tokens("true"), adapters.conversations, CONVS)
spans("tok_exact", "[word=the]", _tokens("word = 'the'"))
spans("tok_regex", "[word=/th.*e/]", _tokens("regexp_full_match(word, 'th.*e')"))
spans("tok_regex_literal", "[word=/^the$/]", _tokens("word = 'the'"))
spans("tok_fuzzy", "[word=ING~]", _tokens("contains(lower(word), 'ing')"))
spans("tok_not", "[tag!=LOW]", _tokens("tag <> 'LOW'"))
spans("tok_not_regex", "[word!=/[a-zA-Z].*/]", _tokens("NOT regexp_full_match(word, '[a-zA-Z].*')"))
spans("tok_not_prefix", "[!tag=LOW & !tag=UP]", _tokens("tag <> 'LOW' AND tag <> 'UP'"))
spans("tok_and", "[tag=UP & lemma=/.*s/]", _tokens("tag = 'UP' AND regexp_full_match(lemma, '.*s')"))
spans("tok_or", "[word=the | tag=CD]", _tokens("word = 'the' OR tag = 'CD'"))
spans("tok_group", "[(word=the | word=of | tag=UP) & !entity=B-CAP]", _tokens("(word = 'the' OR word = 'of' OR tag = 'UP') AND entity <> 'B-CAP'"))
spans("tok_default_field", "the", _tokens("norm = 'the'"), default_field="norm")
spans("tok_bare_regex", "/[tT]h.*/", _tokens("regexp_full_match(word, '[tT]h.*')"))
spans("tok_quoted", "[word='|']", _tokens("word = '|'"))


def _positions(spark, sf_dir):
    hits = _engine(spark, sf_dir).hits("[word=the]")
    return hits.select(*KEY, F.array_join(F.transform("matches", lambda m: m["start"].cast("string")), " ").alias("positions"))


add("tok_positions", _positions, f"SELECT {_SPAN}, string_agg(p::VARCHAR, ' ' ORDER BY p) AS positions FROM tok WHERE word = 'the' GROUP BY ALL")

# Sequences

_NEXT = "a JOIN tok b ON a.sentence_id = b.sentence_id AND b.p = a.p + 1"
_A = "a.doc_id, a.sentence_id, a.sentence_idx, a.p AS match_start"
spans("seq_adjacent2", "[tag=UP] [tag=ING]", f"SELECT {_A}, a.p + 2 AS match_end FROM tok {_NEXT} WHERE a.tag = 'UP' AND b.tag = 'ING'")
spans(
    "seq_adjacent3",
    "[tag=LOW] [word=of] [tag=LOW]",
    f"SELECT {_A}, a.p + 3 AS match_end FROM tok {_NEXT} JOIN tok c ON c.sentence_id = a.sentence_id AND c.p = a.p + 2 WHERE a.tag = 'LOW' AND b.word = 'of' AND c.tag = 'LOW'",
)
spans("seq_wildcard", "[word=the] [] [word=of]", f"SELECT {_A}, a.p + 3 AS match_end FROM tok a JOIN tok b ON a.sentence_id = b.sentence_id AND b.p = a.p + 2 WHERE a.word = 'the' AND b.word = 'of'")
_LATER = "FROM tok a JOIN tok b ON a.sentence_id = b.sentence_id AND b.p > a.p WHERE a.word = 'the' AND b.word = 'of'"
spans("seq_gap_greedy", "[word=the] []* [word=of]", f"SELECT a.doc_id, a.sentence_id, a.sentence_idx, min(a.p) AS match_start, max(b.p) + 1 AS match_end {_LATER} GROUP BY ALL")
spans("seq_gap_per_start", "[word=the] []* [word=of]", f"SELECT {_A}, max(b.p) + 1 AS match_end {_LATER} GROUP BY ALL", overlap="per_start")
spans("seq_gap_lazy", "[word=the] []*? [word=of]", f"SELECT {_A}, min(b.p) + 1 AS match_end {_LATER} GROUP BY ALL")
spans("seq_gap_plus", "[word=the] []+? [word=of]", f"SELECT {_A}, min(b.p) + 1 AS match_end {_LATER} AND b.p > a.p + 1 GROUP BY ALL")
spans("seq_gap_bounded", "[word=the] []{0,3}? [word=of]", f"SELECT {_A}, min(b.p) + 1 AS match_end {_LATER} AND b.p <= a.p + 4 GROUP BY ALL")
spans("seq_gap_bounded_greedy", "[word=the] []{2,5} [word=of]", f"SELECT {_A}, max(b.p) + 1 AS match_end {_LATER} AND b.p BETWEEN a.p + 3 AND a.p + 6 GROUP BY ALL", overlap="per_start")
spans("seq_gap_exact", "[word=the] []{3} [word=of]", f"SELECT {_A}, b.p + 1 AS match_end {_LATER} AND b.p = a.p + 4", overlap="per_start")
spans(
    "seq_rep_plus",
    "[tag=UP]+",
    f", up AS (SELECT *, p - row_number() OVER (PARTITION BY sentence_id ORDER BY p) AS island FROM tok WHERE tag = 'UP') SELECT {_SPAN}, min(p) AS match_start, max(p) + 1 AS match_end FROM up GROUP BY {_SPAN}, island",
)
spans(
    "seq_rep_star",
    "[word=the] [tag=LOW]* [tag=UP]",
    f", stop AS (SELECT *, min(CASE WHEN tag <> 'LOW' THEN p END) OVER (PARTITION BY sentence_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM tok) SELECT s.doc_id, s.sentence_id, s.sentence_idx, min(s.p) AS match_start, s.q + 1 AS match_end FROM stop s JOIN tok b ON b.sentence_id = s.sentence_id AND b.p = s.q AND b.tag = 'UP' WHERE s.word = 'the' GROUP BY s.doc_id, s.sentence_id, s.sentence_idx, s.q",
)
spans("seq_rep_lazy", "[tag=UP]+?", _tokens("tag = 'UP'"))
_LAG = ", near AS (SELECT *, lag(word) OVER o AS before, lag(tag) OVER o AS tag_before, lead(word) OVER o AS after, lead(tag) OVER o AS tag_after, lead(tag, 2) OVER o AS tag_after2 FROM tok WINDOW o AS (PARTITION BY sentence_id ORDER BY p))"
spans(
    "seq_optional",
    "[word=of]? [word=the]",
    f"{_LAG} SELECT {_SPAN}, CASE WHEN before = 'of' THEN p - 1 ELSE p END AS match_start, p + 1 AS match_end FROM near WHERE word = 'the'",
)
spans(
    "seq_range",
    "[tag=UP]{2,3}",
    f"{_LAG} SELECT {_SPAN}, p AS match_start, CASE WHEN tag_after2 = 'UP' THEN p + 3 ELSE p + 2 END AS match_end FROM near WHERE tag = 'UP' AND tag_after = 'UP'",
    overlap="per_start",
)
spans(
    "seq_alt",
    "([word=the] | [word=of] [word=the])",
    f"{_LAG} SELECT {_SPAN}, p AS match_start, p + 1 AS match_end FROM near WHERE word = 'the' UNION ALL SELECT {_SPAN}, p, p + 2 FROM near WHERE word = 'of' AND after = 'the'",
)
spans(
    "seq_noun_phrase",
    "[word=the]? [tag=ING]* [tag=UP]+",
    # Runs of UP, the run of ING before each, and a word before that.
    f""", runs AS (SELECT *, max(CASE WHEN tag <> 'ING' THEN p END) OVER (PARTITION BY sentence_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q,
    lag(tag) OVER (PARTITION BY sentence_id ORDER BY p) AS tag_before, p - sum((tag = 'UP')::INT) OVER (PARTITION BY sentence_id ORDER BY p) AS island FROM tok),
  ends AS (SELECT sentence_id, island, max(p) + 1 AS match_end FROM runs WHERE tag = 'UP' GROUP BY ALL)
  SELECT a.doc_id, a.sentence_id, a.sentence_idx, (CASE WHEN z.word = 'the' THEN a.q ELSE coalesce(a.q + 1, 0) END)::INT AS match_start, e.match_end
  FROM runs a JOIN ends e ON e.sentence_id = a.sentence_id AND e.island = a.island LEFT JOIN tok z ON z.sentence_id = a.sentence_id AND z.p = a.q
  WHERE a.tag = 'UP' AND a.tag_before IS DISTINCT FROM 'UP'""",
)
spans("look_ahead_pos", "[word=the] (?= [tag=ING])", f"{_LAG} SELECT {_SPAN}, p AS match_start, p + 1 AS match_end FROM near WHERE word = 'the' AND tag_after = 'ING'")
spans("look_ahead_neg", "[word=the] (?! [tag=LOW])", f"{_LAG} SELECT {_SPAN}, p AS match_start, p + 1 AS match_end FROM near WHERE word = 'the' AND tag_after IS DISTINCT FROM 'LOW'")
spans("look_behind_pos", "(?<= [word=of]) [word=the]", f"{_LAG} SELECT {_SPAN}, p AS match_start, p + 1 AS match_end FROM near WHERE word = 'the' AND before = 'of'")
spans("look_behind_neg", "(?<! [tag=LOW]) [word=the]", f"{_LAG} SELECT {_SPAN}, p AS match_start, p + 1 AS match_end FROM near WHERE word = 'the' AND tag_before IS DISTINCT FROM 'LOW'")
add("assert_doc_filter", lambda spark, sf_dir: _engine(spark, sf_dir).hits("(?= [word=of] [word=the])").select(*KEY, "score"), f"SELECT DISTINCT a.doc_id, a.sentence_id, a.sentence_idx, 1.0::DOUBLE AS score FROM tok {_NEXT} WHERE a.word = 'of' AND b.word = 'the'")
add("assert_negative_keeps_all", lambda spark, sf_dir: _engine(spark, sf_dir).hits("(?! [word=the])").agg(F.count("*").alias("kept")), "SELECT count(*) AS kept FROM sent")
captures("capture_single", "(?<verb> [tag=ING])", f"SELECT {_SPAN}, p AS match_start, 'verb' AS name, p AS capture_start, p + 1 AS capture_end FROM tok WHERE tag = 'ING'")
captures(
    "capture_seq",
    "[word=the] (?<x> [tag=ING]) (?<y> [tag=LOW])",
    f"{_LAG}, found AS (SELECT * FROM near WHERE word = 'the' AND tag_after = 'ING' AND tag_after2 = 'LOW') SELECT {_SPAN}, p AS match_start, 'x' AS name, p + 1 AS capture_start, p + 2 AS capture_end FROM found UNION ALL SELECT {_SPAN}, p, 'y', p + 2, p + 3 FROM found",
)
spans(
    "events_sequence",
    "[word=click] []{0,2}? [word=purchase]",
    f"SELECT {_A}, min(b.p) + 1 AS match_end FROM tok a JOIN tok b ON a.sentence_id = b.sentence_id AND b.p BETWEEN a.p + 1 AND a.p + 3 WHERE a.word = 'click' AND b.word = 'purchase' GROUP BY ALL",
    adapters.events,
    EVENTS,
)

# Edges

_PATH = "a.doc_id, a.sentence_id, a.sentence_idx, least(a.p, b.p) AS match_start, greatest(a.p, b.p) + 1 AS match_end"
_OUT = "FROM tok a JOIN dep e ON e.sentence_id = a.sentence_id AND e.src = a.p JOIN tok b ON b.sentence_id = a.sentence_id AND b.p = e.dst"
_IN = "FROM tok a JOIN dep e ON e.sentence_id = a.sentence_id AND e.dst = a.p JOIN tok b ON b.sentence_id = a.sentence_id AND b.p = e.src"
spans("graph_out", "[tag=UP] >dep1 [tag=ING]", f"SELECT {_PATH} {_OUT} WHERE e.label = 'dep1' AND a.tag = 'UP' AND b.tag = 'ING'")
spans("graph_in", "[tag=ING] <dep2 [tag=UP]", f"SELECT {_PATH} {_IN} WHERE e.label = 'dep2' AND a.tag = 'ING' AND b.tag = 'UP'")
spans("graph_any_out", "[word=the] >> [word=of]", f"SELECT {_PATH} {_OUT} WHERE a.word = 'the' AND b.word = 'of'")
spans("graph_any_in", "[word=the] << [word=of]", f"SELECT {_PATH} {_IN} WHERE a.word = 'the' AND b.word = 'of'")
spans("graph_regex", "[word=the] >/dep[12]/ [tag=UP]", f"SELECT {_PATH} {_OUT} WHERE e.label IN ('dep1', 'dep2') AND a.word = 'the' AND b.tag = 'UP'")
spans("graph_disj", "[word=the] >dep1|dep3 [tag=ING]", f"SELECT {_PATH} {_OUT} WHERE e.label IN ('dep1', 'dep3') AND a.word = 'the' AND b.tag = 'ING'")
spans(
    "graph_optional",
    "[tag=UP] >dep2? [word!=/[A-Z].*e/]",
    f"SELECT {_PATH} {_OUT} WHERE e.label = 'dep2' AND a.tag = 'UP' AND NOT regexp_full_match(b.word, '[A-Z].*e') UNION ALL SELECT {_SPAN}, p, p + 1 FROM tok WHERE tag = 'UP' AND NOT regexp_full_match(word, '[A-Z].*e')",
    adapters.conversations,
    CONVS,
)
_TWO = "a.doc_id, a.sentence_id, a.sentence_idx, least(a.p, b.p, c.p) AS match_start, greatest(a.p, b.p, c.p) + 1 AS match_end"
spans(
    "graph_two_hop",
    "([tag=/U.*/]) <dep1 ([tag=/L.*/]) >dep2 ([tag=/L.*/])",
    f"SELECT {_TWO} {_IN} JOIN dep f ON f.sentence_id = b.sentence_id AND f.src = b.p JOIN tok c ON c.sentence_id = b.sentence_id AND c.p = f.dst WHERE e.label = 'dep1' AND f.label = 'dep2' AND a.tag = 'UP' AND b.tag = 'LOW' AND c.tag = 'LOW'",
)
spans(
    "graph_concat",
    "[word=the] >dep1>dep3 []",
    f"SELECT a.doc_id, a.sentence_id, a.sentence_idx, least(a.p, f.dst) AS match_start, greatest(a.p, f.dst) + 1 AS match_end FROM tok a JOIN dep e ON e.sentence_id = a.sentence_id AND e.src = a.p JOIN dep f ON f.sentence_id = a.sentence_id AND f.src = e.dst WHERE e.label = 'dep1' AND f.label = 'dep3' AND a.word = 'the'",
)
spans(
    "graph_kleene",
    "[tag=UP] >dep1|dep2* [tag=ING]",
    f", walk(sentence_id, a, b) AS (SELECT sentence_id, p, p FROM tok WHERE tag = 'UP' UNION SELECT w.sentence_id, w.a, e.dst FROM walk w JOIN dep e ON e.sentence_id = w.sentence_id AND e.src = w.b WHERE e.label IN ('dep1', 'dep2')) SELECT t.doc_id, t.sentence_id, t.sentence_idx, least(w.a, w.b) AS match_start, greatest(w.a, w.b) + 1 AS match_end FROM walk w JOIN tok t ON t.sentence_id = w.sentence_id AND t.p = w.b WHERE t.tag = 'ING'",
    adapters.conversations,
    CONVS,
    recursive=True,
)
spans(
    "graph_sequence",
    "[word=of] [word=the] >dep1 [tag=LOW] [tag=LOW]",
    f"SELECT z.doc_id, z.sentence_id, z.sentence_idx, least(z.p, b.p) AS match_start, greatest(a.p + 1, b.p + 2) AS match_end {_OUT} JOIN tok z ON z.sentence_id = a.sentence_id AND z.p = a.p - 1 JOIN tok y ON y.sentence_id = a.sentence_id AND y.p = b.p + 1 WHERE e.label = 'dep1' AND z.word = 'of' AND a.word = 'the' AND b.tag = 'LOW' AND y.tag = 'LOW'",
)
captures(
    "graph_captures",
    "(?<head> [tag=UP]) >dep1 [tag=ING]",
    f", found AS (SELECT a.doc_id, a.sentence_id, a.sentence_idx, a.p AS s, b.p AS t {_OUT} WHERE e.label = 'dep1' AND a.tag = 'UP' AND b.tag = 'ING') SELECT {_SPAN}, least(s, t) AS match_start, 'c0' AS name, s AS capture_start, s + 1 AS capture_end FROM found UNION ALL SELECT {_SPAN}, least(s, t), 'c1', t, t + 1 FROM found UNION ALL SELECT {_SPAN}, least(s, t), 'head', s, s + 1 FROM found",
)
spans("graph_alternation", "[word=the] >dep1 [tag=ING] | [word=of] >dep2 [tag=UP]", f"SELECT {_PATH} {_OUT} WHERE (e.label = 'dep1' AND a.word = 'the' AND b.tag = 'ING') OR (e.label = 'dep2' AND a.word = 'of' AND b.tag = 'UP')")
spans(
    "star_graph",
    "[word=O] >r [word=R]",
    f"SELECT {_SPAN}, 0::INT AS match_start, p + 1 AS match_end FROM items JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_returnflag = 'R'",
    adapters.orders,
    """items AS (SELECT l_orderkey, l_returnflag, l_orderkey::VARCHAR AS doc_id, l_orderkey::VARCHAR || '_0' AS sentence_id, 0::INT AS sentence_idx,
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag))::INT AS p FROM lineitem)""",
)
add(
    "graph_exists",
    lambda spark, sf_dir: _engine(spark, sf_dir).hits("[word=the] >dep1 [word=of]").select(*KEY),
    f"SELECT DISTINCT a.doc_id, a.sentence_id, a.sentence_idx {_OUT} WHERE e.label = 'dep1' AND a.word = 'the' AND b.word = 'of'",
)


def _tok(spark, sf_dir, where: str, adapter=adapters.documents, layers: list[str] | None = None) -> DataFrame:
    """Token rows with the layers given, else with the one of word and tag that the condition names."""
    return views.tokens(adapter(spark, sf_dir), layers or ["tag" if "tag" in where else "word"]).where(where)


def _conv_edges(spark, sf_dir) -> DataFrame:
    return views.edges(adapters.conversations(spark, sf_dir)).where("label in ('dep1', 'dep3')")


add(
    "graph_roots",
    lambda spark, sf_dir: relational.roots(_tok(spark, sf_dir, "true", adapters.conversations), _conv_edges(spark, sf_dir)).groupBy(*KEY).agg(F.count("*").alias("roots")),
    f"SELECT {_SPAN}, count(*) AS roots FROM tok t WHERE NOT EXISTS (SELECT 1 FROM dep d WHERE d.sentence_id = t.sentence_id AND d.dst = t.p AND d.label IN ('dep1', 'dep3')) GROUP BY ALL",
    CONVS,
)
_WALK = ", walk(sentence_id, node, distance, path) AS (SELECT sentence_id, 0, 0, '0' FROM tok WHERE p = 0 UNION ALL SELECT w.sentence_id, e.dst, w.distance + 1, w.path || ' ' || e.dst FROM walk w JOIN dep e ON e.sentence_id = w.sentence_id AND e.src = w.node WHERE e.label IN ('dep1', 'dep3'))"
_WALKED = "FROM walk w JOIN tok t ON t.sentence_id = w.sentence_id AND t.p = w.node"


def _starts(spark, sf_dir):
    return _tok(spark, sf_dir, "position = 0", adapters.conversations)


def _ing(spark, sf_dir):
    return _tok(spark, sf_dir, "tag = 'ING'", adapters.conversations)


add("graph_reachable", lambda spark, sf_dir: closure.distances(_starts(spark, sf_dir), _conv_edges(spark, sf_dir)).select(*KEY, "source", "node", "distance"), f"{_WALK} SELECT t.doc_id, t.sentence_id, t.sentence_idx, 0 AS source, w.node, w.distance {_WALKED}", CONVS, True)
add("graph_has_path", lambda spark, sf_dir: closure.has_path(_starts(spark, sf_dir), _ing(spark, sf_dir), _conv_edges(spark, sf_dir)).select(*KEY, "source", "node"), f"{_WALK} SELECT t.doc_id, t.sentence_id, t.sentence_idx, 0 AS source, w.node {_WALKED} WHERE t.tag = 'ING'", CONVS, True)
add(
    "graph_shortest",
    lambda spark, sf_dir: closure.shortest_path(_starts(spark, sf_dir), _ing(spark, sf_dir), _conv_edges(spark, sf_dir)).select(*KEY, "source", "node", F.array_join(F.col("path").cast("array<string>"), " ").alias("path")),
    f"{_WALK} SELECT t.doc_id, t.sentence_id, t.sentence_idx, 0 AS source, w.node, w.path {_WALKED} WHERE t.tag = 'ING'",
    CONVS,
    True,
)

# The relational forms

add("rel_adjacent", lambda spark, sf_dir: relational.adjacent(_tok(spark, sf_dir, "tag = 'UP'"), _tok(spark, sf_dir, "tag = 'ING'")).select(*KEY, F.col("start").alias("match_start"), F.col("end").alias("match_end")), f"SELECT {_A}, a.p + 2 AS match_end FROM tok {_NEXT} WHERE a.tag = 'UP' AND b.tag = 'ING'")
add("rel_gap_lazy", lambda spark, sf_dir: relational.gap(_tok(spark, sf_dir, "word = 'the'"), _tok(spark, sf_dir, "word = 'of'"), 0, 3, True).select(*KEY, F.col("start").alias("match_start"), F.col("end").alias("match_end")), f"SELECT {_A}, min(b.p) + 1 AS match_end {_LATER} AND b.p <= a.p + 4 GROUP BY ALL")
add("rel_gap_greedy", lambda spark, sf_dir: relational.gap(_tok(spark, sf_dir, "word = 'the'"), _tok(spark, sf_dir, "word = 'of'"), 2, None, False).select(*KEY, F.col("start").alias("match_start"), F.col("end").alias("match_end")), f"SELECT {_A}, max(b.p) + 1 AS match_end {_LATER} AND b.p > a.p + 2 GROUP BY ALL")
add("rel_runs", lambda spark, sf_dir: relational.runs(_tok(spark, sf_dir, "tag = 'UP'")).select(*KEY, F.col("start").alias("match_start"), F.col("end").alias("match_end")), f", up AS (SELECT *, p - row_number() OVER (PARTITION BY sentence_id ORDER BY p) AS island FROM tok WHERE tag = 'UP') SELECT {_SPAN}, min(p) AS match_start, max(p) + 1 AS match_end FROM up GROUP BY {_SPAN}, island")


def _rel_hop(spark, sf_dir):
    edges = views.edges(adapters.documents(spark, sf_dir))
    return relational.hop(_tok(spark, sf_dir, "tag = 'UP'"), edges, _tok(spark, sf_dir, "tag = 'ING'"), "out", F.col("label") == "dep1").select(*KEY, "source", "target")


add("rel_hop", _rel_hop, f"SELECT a.doc_id, a.sentence_id, a.sentence_idx, a.p AS source, b.p AS target {_OUT} WHERE e.label = 'dep1' AND a.tag = 'UP' AND b.tag = 'ING'")

# Scores, top-k, sets

_HALVES = f"hits AS (SELECT {_SPAN}, greatest(1.0, count(*) * 0.5)::DOUBLE AS score FROM tok WHERE {{}} GROUP BY ALL)"
add(
    "score_sum",
    lambda spark, sf_dir: _engine(spark, sf_dir).hits("[word=the] []{0,3}? [word=of]").select(*KEY, F.round("score", 6).alias("score")),
    f", m AS (SELECT {_A}, min(b.p) + 1 AS match_end {_LATER} AND b.p <= a.p + 4 GROUP BY ALL) SELECT {_SPAN}, round(greatest(1.0, sum(1.0::DOUBLE / (1 + match_end - match_start))), 6)::DOUBLE AS score FROM m GROUP BY ALL",
)
add("topk", lambda spark, sf_dir: _engine(spark, sf_dir).query("[word=the]", 20).select(*KEY, "score"), f", {_HALVES.format(chr(39).join(['word = ', 'the', '']))} SELECT * FROM hits ORDER BY score DESC, doc_id, sentence_idx LIMIT 20")


def _two(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return e.hits("[word=the]").select(*KEY, "score"), e.hits("[word=of]").select(*KEY, "score")


_BOTH = f", a AS (SELECT {_SPAN}, greatest(1.0, count(*) * 0.5)::DOUBLE AS score FROM tok WHERE word = 'the' GROUP BY ALL), b AS (SELECT {_SPAN}, greatest(1.0, count(*) * 0.5)::DOUBLE AS score FROM tok WHERE word = 'of' GROUP BY ALL)"
_EITHER = f"SELECT {_SPAN}, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL"
add("dedup_max", lambda spark, sf_dir: results.dedup_max(_two(spark, sf_dir)[0].unionByName(_two(spark, sf_dir)[1])), f"{_BOTH} {_EITHER}")
add("merge_union", lambda spark, sf_dir: results.merge(*_two(spark, sf_dir), limit=50), f"{_BOTH} SELECT * FROM ({_EITHER}) ORDER BY score DESC, doc_id, sentence_idx LIMIT 50")
add("set_intersection", lambda spark, sf_dir: _two(spark, sf_dir)[0].join(_two(spark, sf_dir)[1], KEY, "left_semi"), f"{_BOTH} SELECT * FROM a SEMI JOIN b USING (sentence_id)")
add("set_difference", lambda spark, sf_dir: _two(spark, sf_dir)[0].join(_two(spark, sf_dir)[1], KEY, "left_anti"), f"{_BOTH} SELECT * FROM a ANTI JOIN b USING (sentence_id)")
add("summary", lambda spark, sf_dir: results.summary(_engine(spark, sf_dir).hits("[word=the]")), f", {_HALVES.format(chr(39).join(['word = ', 'the', '']))} SELECT count(*) AS total_hits, max(score) AS max_score FROM hits")

# Views, accessors, statistics, validation, sources

add("tokens_view", lambda spark, sf_dir: _tok(spark, sf_dir, "true", adapters.conversations, ["word", "tag"]).select(*KEY, "position", "word", "tag"), f"SELECT {_SPAN}, p AS position, word, tag FROM tok", CONVS)
add("edges_view", lambda spark, sf_dir: views.edges(adapters.orders(spark, sf_dir)), f"SELECT t.doc_id, t.sentence_id, t.sentence_idx, d.src, d.dst, d.label FROM dep d JOIN tok t ON t.sentence_id = d.sentence_id AND t.p = d.dst", ORDERS)
add("label_vocabulary", lambda spark, sf_dir: views.label_vocabulary(adapters.documents(spark, sf_dir)), "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS label_id FROM (SELECT DISTINCT label FROM dep)")
add("stats", lambda spark, sf_dir: corpus_stats(adapters.documents(spark, sf_dir)), "SELECT count(DISTINCT doc_id) AS documents, count(*) AS sentences, sum(n)::BIGINT AS tokens, sum(n - 1)::BIGINT AS edges FROM sent")


def _match_text(spark, sf_dir):
    hits = _engine(spark, sf_dir).hits("[tag=UP] [tag=ING]")
    rows = hits.select(*KEY, "word", F.inline("matches"))
    return rows.select(*KEY, F.col("start").alias("match_start"), S.match_text(F.col("word"), F.col("start"), F.col("end")).alias("match_text"))


add("match_text", _match_text, f"SELECT {_A}, a.word || ' ' || b.word AS match_text FROM tok {_NEXT} WHERE a.tag = 'UP' AND b.tag = 'ING'")
add("sentence_text", lambda spark, sf_dir: adapters.documents(spark, sf_dir).select(*KEY, S.sentence_text().alias("sentence_text")), f"SELECT {_SPAN}, array_to_string(word, ' ') AS sentence_text FROM sent")
add("deps_string", lambda spark, sf_dir: adapters.orders(spark, sf_dir).select(*KEY, S.deps_string().alias("edges")), f"SELECT {_SPAN}, string_agg('0:' || p || ':' || lower(word), ' ' ORDER BY p) AS edges FROM raw WHERE p > 0 GROUP BY ALL", ORDERS)
add(
    "edges_at_token",
    lambda spark, sf_dir: adapters.conversations(spark, sf_dir).select(*KEY, F.size(S.outgoing(F.col("deps"), F.lit(1))).alias("out_edges"), F.size(S.incoming(F.col("deps"), F.lit(1))).alias("in_edges")),
    f"SELECT {_SPAN}, greatest(0, least(2, n - 3))::INT AS out_edges, (n > 1)::INT AS in_edges FROM sent",
    CONVS,
)


def _validate(spark, sf_dir):
    """Sentences declared shorter than they are."""
    s = adapters.documents(spark, sf_dir).withColumn("sentence_length", F.least(F.col("sentence_length"), F.lit(50)))
    return reader.validate(s, ["word", "tag"]).groupBy("problem", "error").agg(F.count("*").alias("sentences"))


add("validate_edges", _validate, ", long AS (SELECT count(*) AS c FROM sent WHERE n > 50) SELECT 'edge beyond the sentence' AS problem, true AS error, c AS sentences FROM long UNION ALL SELECT 'layer word has another length', false, c FROM long UNION ALL SELECT 'layer tag has another length', false, c FROM long")


def _ingest(spark, sf_dir):
    """Documents written as JSON text, parsed, and turned into sentences again."""
    fields = F.array(
        F.struct(F.lit("word").alias("name"), F.lit("TokensField").alias("$type"), F.col("word").alias("tokens"), F.lit(None).cast("array<array<string>>").alias("edges")),
        F.struct(
            F.lit("dependencies").alias("name"),
            F.lit("GraphField").alias("$type"),
            F.lit(None).cast("array<string>").alias("tokens"),
            F.transform("deps", lambda e: F.array(e["src"].cast("string"), e["dst"].cast("string"), e["label"])).alias("edges"),
        ),
    )
    s = adapters.conversations(spark, sf_dir).select(F.col("sentence_id").alias("id"), F.array(F.struct(F.col("sentence_length").alias("numTokens"), fields.alias("fields"))).alias("sentences"))
    documents = reader.parse_json(s.select(F.to_json(F.struct("id", "sentences")).alias("json")), "json")
    back = reader.to_sentences(documents, reader.SchemaConfig(["word"], ["word"]))
    return back.select("doc_id", "sentence_id", "sentence_length", S.sentence_text().alias("sentence_text"), F.size("deps").alias("n_edges"))


add("ingest_json", _ingest, "SELECT sentence_id AS doc_id, sentence_id || '_0' AS sentence_id, n AS sentence_length, array_to_string(word, ' ') AS sentence_text, (n - 1)::INT AS n_edges FROM sent", CONVS)


def _map_fields(spark, sf_dir):
    hits = _engine(spark, sf_dir, output_fields=["word", "tag"]).hits("[word=the]")
    return results.as_map(hits, ["word", "tag"]).select(*KEY, F.array_join(F.col("fields")["tag"], " ").alias("tags"))


add("output_fields", _map_fields, f"SELECT {_SPAN}, string_agg(tag, ' ' ORDER BY p) AS tags FROM tok WHERE sentence_id IN (SELECT sentence_id FROM tok WHERE word = 'the') GROUP BY ALL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy sequence with captures, best hits first."""
    return _engine(spark, sf_dir).query("(?<head> [tag=UP]+) []{0,5}? (?<tail> [tag=ING])", 100)
