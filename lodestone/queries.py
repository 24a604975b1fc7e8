"""Every operator as a registered query over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

import json
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.api import SearchIndex, details, json_rows, search_first
from lodestone.functions import rendering, scoring, sets
from lodestone.functions.analysis import LOWER, tokens
from lodestone.operators import evaluate, suggest
from lodestone.operators.index import Index, block_maxima, build
from lodestone.plans import search as plans
from lodestone.plans import store
from lodestone.sources import csv_fields, frame_source, json_keys, numbered, parquet_metadata, parquet_row_groups, read_source, row_at, scratch, to_csv
from lodestone.streaming.incremental import index_stream, open_segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_built: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(spark: SparkSession, sf_dir: str, name: str, fields: list[str], id_col: str) -> Index:
    """The index of a table, built at most once in a session and kept in memory and on disk."""
    kept = _built.setdefault(spark, {})
    key = (sf_dir, name, tuple(fields))
    if key not in kept:
        kept[key] = build(table(spark, sf_dir, name), fields, id_col).persist()
    return kept[key]


def documents(spark: SparkSession, sf_dir: str) -> Index:
    return indexed(spark, sf_dir, "documents", ["text"], "doc_id")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL building blocks -------------------------------------------------------------------------------------------

_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"


def fold_sql(c: str) -> str:
    return f"translate({c}, '{LOWER}', '{LOWER.upper()}')"


def terms_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({fold_sql(f"coalesce({c}, '')")}, '{_SEP}'), lambda x: x <> '')"


def index_sql(name: str, id_col: str, fields: dict[str, str]) -> str:
    """CTEs: rows, occ (with positions), tf, dfs, stats."""
    each = " UNION ALL ".join(f"SELECT {id_col} AS doc_id, '{f.upper()}' AS field, {terms_sql(e)} AS t FROM {name}" for f, e in fields.items())
    return f"""rows AS ({each}), lens AS (SELECT field, doc_id, len(t) AS dl FROM rows),
occ AS (SELECT field, doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM rows),
tf AS (SELECT field, doc_id, term, count(*) AS tf, min(pos) AS first_pos FROM occ GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY ALL),
stats AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY ALL)"""


def search_sql(name: str, id_col: str, fields: dict[str, str], terms: list[tuple[str, str, float]], how: str = "bm25", k: int = 10, conjunctive: bool = False, phrase: list[tuple[str, str, str]] = (), first: bool = False, extra: str = "", select: str = "doc_id, score") -> str:
    """terms: (field, term, boost), repeats included."""
    rows = ", ".join(f"('{f}', '{t}', {b})" for f, t, b in terms)
    weight = "q.boost * (1 + log2(n * 1.0 / df))"
    one = f"{weight} * 2.4 * tf / (tf + 1.4 * 0.25 + 1.4 * 0.75 * dl / avgdl)" if how == "bm25" else f"{weight} * tf"
    bonus = " + CASE WHEN first_pos = 0 THEN 25 ELSE 0 END" if first else ""
    having = f" HAVING count(DISTINCT field || chr(1) || term) = {len({t[:2] for t in terms})}" if conjunctive else ""
    sql = f"""WITH {index_sql(name, id_col, fields)}, q(field, term, boost) AS (VALUES {rows}),
hits AS (SELECT doc_id, sum({one}{bonus}) AS s FROM q JOIN tf USING (field, term) JOIN dfs USING (field, term) JOIN stats USING (field) JOIN lens USING (field, doc_id) GROUP BY doc_id{having})"""
    if phrase:
        pairs = ", ".join(f"('{f}', '{a}', '{b}')" for f, a, b in phrase)
        sql += f""", pr(field, a, b) AS (VALUES {pairs}), adj AS (SELECT o.doc_id, count(*) AS c FROM occ o JOIN pr ON o.field = pr.field AND o.term = pr.a JOIN occ p ON p.field = o.field AND p.doc_id = o.doc_id AND p.pos = o.pos + 1 AND p.term = pr.b GROUP BY ALL),
best AS (SELECT doc_id, round(s * pow(1.4, coalesce(c, 0)), 6) AS score FROM hits LEFT JOIN adj USING (doc_id) ORDER BY score DESC, doc_id LIMIT {k})"""
    else:
        sql += f", best AS (SELECT doc_id, round(s, 6) AS score FROM hits WHERE s > 0 ORDER BY score DESC, doc_id LIMIT {k})"
    return f"{sql}{extra} SELECT {select} FROM best"


TEXT = {"text": "text"}
WORDS3 = [("TEXT", t, 1.0) for t in ("THE", "IN", "ATSHSH")]

# --- analysis ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({terms_sql('text')}) AS dl FROM documents")
def q_tokenize_stats(spark, sf_dir):
    return documents(spark, sf_dir).doc_len.select("doc_id", F.col("dl").cast("long"))


@query(f"SELECT item_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS term FROM (SELECT item_id, {terms_sql('text')} AS t FROM benchmark)")
def q_token_positions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tokens("text", most=None)).alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT term, count(*) AS cf FROM (SELECT unnest({terms_sql('text')}) AS term FROM documents) WHERE octet_length(encode(term)) > length(term) GROUP BY term")
def q_casefold_ascii(spark, sf_dir):
    return documents(spark, sf_dir).terms.where(F.octet_length("term") > F.length("term")).select("term", "cf")


@query(f"""WITH long AS (SELECT item_id, replace({fold_sql('text')}, ' ', 'X') AS t FROM benchmark), toks AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(t, '{_SEP}'), lambda x: x <> '')) AS term FROM long)
SELECT item_id, length(part) AS len, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(term, '(?s)(.{{1,253}}).?', 1)) AS part FROM toks) GROUP BY ALL""")
def q_long_token_split(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tokens(F.replace("text", F.lit(" "), F.lit("x")), most=None)).alias("part"))
    return rows.groupBy("item_id", F.length("part").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))


# --- index ---------------------------------------------------------------------------------------------------------


@query(f"WITH {index_sql('documents', 'doc_id', TEXT)} SELECT term, doc_id, tf FROM tf WHERE term IN ('THE', 'IN', 'ATSHSH', 'ZEBRA')")
def q_term_freq(spark, sf_dir):
    return documents(spark, sf_dir).hits().where(F.col("term").isin("THE", "IN", "ATSHSH", "ZEBRA")).select("term", "doc_id", F.col("tf").cast("long"))


@query(f"WITH {index_sql('documents', 'doc_id', TEXT)} SELECT term, df, cf FROM dfs ORDER BY df DESC, term LIMIT 100")
def q_doc_freq(spark, sf_dir):
    return documents(spark, sf_dir).terms.select("term", "df", "cf").orderBy(F.desc("df"), "term").limit(100)


@query(f"WITH {index_sql('documents', 'doc_id', TEXT)} SELECT field, n AS n_docs, round(avgdl, 6) AS avg_dl FROM stats UNION ALL (WITH {index_sql('part', 'p_partkey', {'p_name': 'p_name', 'p_type': 'p_type'})} SELECT field, n, round(avgdl, 6) FROM stats)")
def q_field_stats(spark, sf_dir):
    both = documents(spark, sf_dir).stats.unionByName(parts(spark, sf_dir).stats)
    return both.select("field", "n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query(f"""WITH {index_sql('documents', 'doc_id', TEXT)}, numbered AS (SELECT field, term, doc_id, tf, dl, (row_number() OVER (PARTITION BY field, term ORDER BY doc_id) - 1) // 64 AS block FROM tf JOIN lens USING (field, doc_id))
SELECT term, block, max(tf) AS max_tf, max(doc_id) AS max_doc_id, arg_min(dl, (-tf, dl)) AS max_tf_dl FROM numbered GROUP BY ALL""")
def q_block_maxima(spark, sf_dir):
    got = block_maxima(documents(spark, sf_dir).hits())
    return got.select("term", F.col("block").cast("long"), F.col("max_tf").cast("long"), "max_doc_id", F.col("max_tf_dl").cast("long"))


@query(f"WITH {index_sql('documents', 'doc_id', TEXT)} SELECT term, round(1 + log2(n * 1.0 / df), 6) AS idf FROM dfs JOIN stats USING (field)")
def q_idf(spark, sf_dir):
    i = documents(spark, sf_dir)
    return i.terms.join(F.broadcast(i.stats), "field").select("term", F.round(scoring.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


# --- retrieval -----------------------------------------------------------------------------------------------------


@query(search_sql("documents", "doc_id", TEXT, WORDS3))
def q_bm25_or_top10(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"text": "the in atshsh"})


@query(search_sql("documents", "doc_id", TEXT, WORDS3[:1], k=25))
def q_bm25_single_term(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"TEXT": "The"}, 25)


@query(search_sql("documents", "doc_id", TEXT, WORDS3[:1], "tfidf"))
def q_tfidf_single_term(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"text": "the"}, how="tfidf")


@query(f"SELECT 1 AS query_no, * FROM ({search_sql('documents', 'doc_id', TEXT, WORDS3[:1], 'tfidf')}) UNION ALL SELECT 2, * FROM ({search_sql('documents', 'doc_id', TEXT, WORDS3[:2])})")
def q_auto_scoring(spark, sf_dir):
    one, two = (plans.search_ids(documents(spark, sf_dir), {"text": t}, how="auto") for t in ("the zzzzqqq", "the in"))
    return one.select(F.lit(1).alias("query_no"), "*").unionByName(two.select(F.lit(2).alias("query_no"), "*"))


@query(search_sql("documents", "doc_id", TEXT, [*WORDS3, WORDS3[1]]))
def q_bm25_dup_terms(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"text": "the in in atshsh"})


PART = {"p_name": "p_name", "p_type": "p_type"}
COLD = [("P_NAME", "COLD", 2.0), ("P_NAME", "WIDGET", 2.0), ("P_TYPE", "ECONOMY", 1.0)]


def parts(spark, sf_dir) -> Index:
    return indexed(spark, sf_dir, "part", ["p_name", "p_type"], "p_partkey")


COLD_TEXTS = {"p_name": "cold widget", "P_TYPE": "economy"}


@query(search_sql("part", "p_partkey", PART, COLD, k=20))
def q_multifield_boost(spark, sf_dir):
    return plans.search_ids(parts(spark, sf_dir), COLD_TEXTS, 20, {"p_name": 2.0, "P_Type": 1.0})


CONV = "(SELECT conv_id * 1000 + turn AS id, role, text FROM conversations)"


@query(search_sql(CONV, "id", {"role": "role", "text": "text"}, [("ROLE", "ASSISTANT", 0.5), ("TEXT", "THE", 1.0), ("TEXT", "IS", 1.0)], k=30))
def q_multifield_3(spark, sf_dir):
    kept = _built.setdefault(spark, {})
    if (sf_dir, "conversations") not in kept:
        frame = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
        kept[sf_dir, "conversations"] = build(frame, ["role", "text"], "id").persist()
    return plans.search_ids(kept[sf_dir, "conversations"], {"role": "assistant", "text": "the is"}, 30, {"ROLE": 0.5})


@query(search_sql("documents", "doc_id", TEXT, WORDS3, conjunctive=True))
def q_and_top10(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"text": "the in atshsh"}, mode="and")


@query(f"SELECT count(*) AS n FROM ({search_sql('documents', 'doc_id', TEXT, [*WORDS3, ('TEXT', 'ZZZZQQQ', 1.0)], conjunctive=True)})")
def q_and_unknown_term(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"text": "the in atshsh zzzzqqq"}, mode="and").agg(F.count(F.lit(1)).alias("n"))


@query(search_sql("documents", "doc_id", TEXT, WORDS3))
def q_unknown_terms_ignored(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"text": "zzzzqqq the in atshsh"})


@query(search_sql("documents", "doc_id", TEXT, [("TEXT", "OF", 1.0), ("TEXT", "THE", 1.0)], phrase=[("TEXT", "OF", "THE")]))
def q_phrase_boost(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"text": "of the"}, phrases=True)


@query(search_sql("documents", "doc_id", TEXT, WORDS3[:2], first=True, k=40))
def q_first_position_bonus(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"text": "the in"}, 40, first_place=True)


@query(search_sql("documents", "doc_id", TEXT, [("TEXT", t, 1.0) for t in ("LICENSED", "UNDER", "THE", "LICENSE")], k=1000))
def q_query_ids(spark, sf_dir):
    return plans.search_ids(documents(spark, sf_dir), {"text": "licensed under the license"}, 1000)


@query(search_sql("documents", "doc_id", TEXT, WORDS3, select="d.doc_id, d.text, d.lang, d.source, d.n_chars, best.score AS \"SCORE\"") + " JOIN documents d USING (doc_id)")
def q_fetch_rows(spark, sf_dir):
    return plans.search(documents(spark, sf_dir), {"text": "the in atshsh"})


_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
_PART_JOIN = " JOIN part d ON d.p_partkey = best.doc_id"


@query(search_sql("part", "p_partkey", PART, COLD, select="d.p_partkey, d.p_name, printf('%.4f', round(best.score, 4)) AS \"SCORE\"") + _PART_JOIN)
def q_result_json_string(spark, sf_dir):
    rows = json_rows(plans.search(parts(spark, sf_dir), COLD_TEXTS, 10, {"P_NAME": 2.0}))
    return rows.select(*(F.get_json_object("json", f"$.{c}").alias(a) for c, a in (("P_PARTKEY", "p_partkey"), ("P_NAME", "p_name"), ("SCORE", "SCORE")))).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query(search_sql("part", "p_partkey", PART, COLD, select="d.p_name, d.p_type, d.p_partkey, d.p_brand, d.p_size, d.p_retailprice, best.score AS \"SCORE\"") + _PART_JOIN)
def q_search_cols_first(spark, sf_dir):
    i = parts(spark, sf_dir)
    return search_first(i, plans.search(i, COLD_TEXTS, 10, {"P_NAME": 2.0}))


@query("WITH b AS (" + search_sql("part", "p_partkey", PART, COLD, k=1, select="d.*") + _PART_JOIN + ") " + " UNION ALL ".join(f"SELECT '{c.upper()}' AS key, CAST({c} AS VARCHAR) AS value FROM b" for c in _PART_COLUMNS if c != "p_retailprice"))
def q_detail_kv(spark, sf_dir):
    return details(plans.search(parts(spark, sf_dir), COLD_TEXTS, 1, {"P_NAME": 2.0}).drop("SCORE", "p_retailprice"))


BATCH_SQL = f"""WITH {index_sql('documents', 'doc_id', TEXT)}, q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, round(sum(times * (1 + log2(n * 1.0 / df)) * 2.4 * tf / (tf + 1.4 * 0.25 + 1.4 * 0.75 * dl / avgdl)), 6) AS score FROM q JOIN tf USING (term) JOIN dfs USING (field, term) JOIN stats USING (field) JOIN lens USING (field, doc_id) GROUP BY ALL),
run AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, score FROM hits QUALIFY rank <= 10)"""


def _run(spark, sf_dir) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("TEXT").alias("field"), "text")
    return plans.batch(documents(spark, sf_dir), asked, 10)


@query(f"{BATCH_SQL} SELECT query_id, doc_id, rank, score FROM run")
def q_batch_search(spark, sf_dir):
    return _run(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{BATCH_SQL}, qrels AS (SELECT item_id AS query_id, doc_id, 1 AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ideal AS (SELECT query_id, count(*) AS n_rel, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) END) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS i FROM qrels) GROUP BY ALL),
got AS (SELECT query_id, count(*) AS found, sum(nth * 1.0 / rank) AS ps, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM run JOIN qrels USING (query_id, doc_id)) GROUP BY ALL)
SELECT count(*) AS n_queries, round(avg(coalesce(found, 0) / 10.0), 6) AS p_at_k, round(avg(coalesce(found, 0) * 1.0 / n_rel), 6) AS recall_at_k, round(avg(coalesce(ps, 0) / n_rel), 6) AS map_at_k, round(avg(coalesce(dcg, 0) / idcg), 6) AS ndcg_at_k FROM ideal LEFT JOIN got USING (query_id)""")
def q_eval_metrics(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rel = evaluate.containing(documents(spark, sf_dir), "text", items).withColumn("grade", F.lit(1))
    return evaluate.metrics(_run(spark, sf_dir), rel, 10)


@query("SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) UNION ALL SELECT item_id + 100000, doc_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 4, 30)) UNION ALL SELECT -1, doc_id FROM documents WHERE contains(text, 'he i')")
def q_containing(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), "text").union(items.select(F.col("item_id") + 100000, F.substring("text", 4, 30)))
    asked = asked.union(spark.createDataFrame([(-1, "he i")], "query_id long, text string"))
    return evaluate.containing(documents(spark, sf_dir), "text", asked)


# --- dictionaries --------------------------------------------------------------------------------------------------

_VOCABULARY = f"WITH {index_sql('documents', 'doc_id', TEXT)}, voc AS (SELECT term AS key, df AS score FROM dfs)"


def _vocabulary(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).terms.select(F.col("term").alias("key"), F.col("df").alias("score"))


@query(f"{_VOCABULARY} SELECT key, score FROM voc WHERE key = 'THE'")
def q_prefix_exact(spark, sf_dir):
    return suggest.find(_vocabulary(spark, sf_dir), "THE")


@query(f"{_VOCABULARY} SELECT key, score FROM voc WHERE starts_with(key, 'ATS') ORDER BY key LIMIT 50")
def q_prefix_enum(spark, sf_dir):
    return suggest.prefix_keys(_vocabulary(spark, sf_dir), "ATS", 50)


@query(f"{_VOCABULARY} SELECT key, score FROM voc WHERE starts_with(key, 'TH') ORDER BY score DESC, key LIMIT 10")
def q_prefix_topk(spark, sf_dir):
    return suggest.prefix_top(_vocabulary(spark, sf_dir), "TH", 10)


def _entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("value"), F.col("p_partkey").alias("ord"))


@query("SELECT p_name AS key, arg_max(p_partkey, p_partkey) AS value FROM part GROUP BY ALL")
def q_trie_upsert(spark, sf_dir):
    return suggest.upsert(_entries(spark, sf_dir))


@query("SELECT p_name AS key, arg_min(p_partkey, p_partkey) AS value FROM part GROUP BY ALL")
def q_trie_insert_absent(spark, sf_dir):
    return suggest.insert_absent(_entries(spark, sf_dir))


@query("SELECT p_brand AS key, arg_max(p_partkey, p_partkey) AS value, arg_max(p_size, p_partkey) AS score FROM part GROUP BY ALL")
def q_trie_scored_upsert(spark, sf_dir):
    return suggest.upsert_scored(table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("value"), F.col("p_size").alias("score"), F.col("p_partkey").alias("ord")))


@query("SELECT c AS character, CAST(sum(length(p_name) - i) AS BIGINT) AS weight FROM (SELECT p_name, unnest(string_split(p_name, '')) AS c, generate_subscripts(string_split(p_name, ''), 1) - 1 AS i FROM part) GROUP BY c")
def q_char_frequency(spark, sf_dir):
    return suggest.character_frequencies(table(spark, sf_dir, "part"), "p_name")


# --- sources -------------------------------------------------------------------------------------------------------


@query("SELECT upper(k) AS key, min(event_id) AS first FROM (SELECT event_id, unnest(json_keys(props::JSON)) AS k FROM events) GROUP BY ALL")
def q_json_keys(spark, sf_dir):
    return json_keys("props", "event_id", table(spark, sf_dir, "events"))


@query(search_sql("events", "event_id", {"props": "props"}, [("PROPS", "K", 1.0), ("PROPS", "7", 1.0)], k=20))
def q_json_scalar_search(spark, sf_dir):
    return plans.search_ids(indexed(spark, sf_dir, "events", ["props"], "event_id"), {"props": "k 7"}, 20)


@query(search_sql("part", "p_partkey", {"p_size": "CAST(p_size AS VARCHAR)", "p_brand": "p_brand"}, [("P_SIZE", "7", 1.0), ("P_BRAND", "3", 1.0), ("P_BRAND", "BRAND", 1.0)], k=20))
def q_numeric_column_search(spark, sf_dir):
    return plans.search_ids(indexed(spark, sf_dir, "part", ["p_size", "p_brand"], "p_partkey"), {"p_size": "7", "p_brand": "brand#3"}, 20)


@query(search_sql("pages", "page_id", {"html": "html"}, [("HTML", t, 1.0) for t in ("DIV", "CLASS", "NAV")], k=15))
def q_html_field_search(spark, sf_dir):
    return plans.search_ids(indexed(spark, sf_dir, "pages", ["html"], "page_id"), {"html": "<div class='nav'>"}, 15)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, upper(column_name) AS column_name, row_number() OVER () - 1 AS ordinal FROM (DESCRIBE {t})" for t in _TABLES))
def q_parquet_schema(spark, sf_dir):
    rows = [(t, c.upper(), i) for t in _TABLES for i, c in enumerate(table(spark, sf_dir, t).columns)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal long")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def q_row_counts(spark, sf_dir):
    out = [parquet_metadata(spark, f"{sf_dir}/{t}.parquet").agg(F.lit(t).alias("table_name"), F.sum("rows").alias("n")) for t in _TABLES]
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


@query("SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER () AS rn FROM part) WHERE rn = 42")
def q_row_by_ordinal(spark, sf_dir):
    return row_at(spark, f"{sf_dir}/part.parquet", 41).select("p_partkey", "p_name")


def _round_trip(spark, sf_dir, kind: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), f"{scratch(spark, 'trip')}.{kind}"
    if kind == "csv":
        to_csv(docs, path)
    else:
        docs.write.json(path, ignoreNullFields=False)
    return plans.search_ids(build(read_source(spark, path), ["text"], "DOC_ID").settle(), {"text": "the in atshsh"})


@query(search_sql("documents", "doc_id", TEXT, WORDS3))
def q_csv_roundtrip_search(spark, sf_dir):
    return _round_trip(spark, sf_dir, "csv")


@query(search_sql("documents", "doc_id", TEXT, WORDS3))
def q_json_roundtrip_search(spark, sf_dir):
    return _round_trip(spark, sf_dir, "json")


@query(search_sql("documents", "doc_id", TEXT, WORDS3))
def q_saved_index_search(spark, sf_dir):
    path = scratch(spark, "index")
    store.save(build(table(spark, sf_dir, "documents"), ["text"], "doc_id"), path, "documents")
    return plans.search_ids(store.load(spark, path), {"text": "the in atshsh"})


@query(search_sql("part", "p_partkey", PART, COLD, k=20))
def q_dataframe_ingest(spark, sf_dir):
    frame = frame_source(spark, table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    return plans.search_ids(build(frame, ["P_NAME", "P_TYPE"], "P_PARTKEY"), COLD_TEXTS, 20, {"P_NAME": 2.0})


@query("SELECT row_number() OVER (ORDER BY n_name) - 1 AS id, n_name FROM nation")
def q_row_numbers(spark, sf_dir):
    ordered = table(spark, sf_dir, "nation").select("n_name").repartitionByRange(3, "n_name").sortWithinPartitions("n_name")
    return numbered(ordered, "id")


@query(search_sql("documents", "doc_id", TEXT, WORDS3))
def q_streamed_index_search(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "segments")
    source = f"{sf_dir}/documents.parque[t]"  # a pattern, since a stream's plain path must be a folder
    index_stream(spark, source, docs.schema, ["text"], "doc_id", f"{path}/index", f"{path}/progress").awaitTermination()
    return plans.search_ids(open_segments(spark, f"{path}/index", ["text"], "doc_id"), {"text": "the in atshsh"})


# --- texts of results, and small operators ---------------------------------------------------------------------------


_MARKED = "'R&D <b>gthe</b> in-g: ' || text || ' \"thing\" it''s'"


@query(f"""WITH texts AS (SELECT item_id, {_MARKED} AS t FROM benchmark),
chars AS (SELECT item_id, i, substring(t, CAST(i AS BIGINT), 1) AS c FROM texts, unnest(range(1, length(t) + 1)) u(i)),
kept AS (SELECT item_id, i, lower(c) AS c, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM chars WHERE regexp_full_match(lower(c), '[a-z0-9]')),
flat AS (SELECT item_id, string_agg(c, '' ORDER BY k) AS f FROM kept GROUP BY item_id),
hits AS (SELECT item_id, k, length(w) AS n FROM flat, unnest(range(1, length(f) + 1)) u(k), (VALUES ('the'), ('thi'), ('ing')) v(w) WHERE substring(f, CAST(k AS BIGINT), length(w)) = w),
ranges AS (SELECT h.item_id, a.i AS a, b.i AS b FROM hits h JOIN kept a ON a.item_id = h.item_id AND a.k = h.k JOIN kept b ON b.item_id = h.item_id AND b.k = h.k + h.n - 1),
inside AS (SELECT DISTINCT item_id, i FROM ranges, unnest(range(a, b + 1)) u(i)),
marked AS (SELECT c.item_id, c.i, c.c, m.i IS NOT NULL AS m FROM chars c LEFT JOIN inside m ON m.item_id = c.item_id AND m.i = c.i),
edges AS (SELECT *, coalesce(lag(m) OVER w, false) AS before, coalesce(lead(m) OVER w, false) AS after FROM marked WINDOW w AS (PARTITION BY item_id ORDER BY i))
SELECT item_id, string_agg((CASE WHEN m AND NOT before THEN '<span class="highlight">' ELSE '' END) || (CASE c WHEN '&' THEN '&amp;' WHEN '<' THEN '&lt;' WHEN '>' THEN '&gt;' WHEN '"' THEN '&quot;' WHEN '''' THEN '&#x27;' ELSE c END) || (CASE WHEN m AND NOT after THEN '</span>' ELSE '' END), '' ORDER BY i) AS html FROM edges GROUP BY item_id""")
def q_highlight(spark, sf_dir):
    text = F.concat(F.lit("R&D <b>gthe</b> in-g: "), "text", F.lit(' "thing" it\'s'))
    return table(spark, sf_dir, "benchmark").select("item_id", rendering.highlight(text, "The thi! ing").alias("html"))


@query("""SELECT page_id, url_decode(replace(regexp_extract(s, 'q=([^&]*)', 1), '+', ' ')) AS q, url_decode(replace(regexp_extract(s, 'title=([^&]*)', 1), '+', ' ')) AS title FROM (SELECT page_id, 'title=' || replace(url, '/', '%2F') || '&q=under+my+skin%21' AS s FROM pages)""")
def q_url_query_parse(spark, sf_dir):
    s = F.concat(F.lit("title="), F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("&q=under+my+skin%21"))
    return table(spark, sf_dir, "pages").select("page_id", rendering.decode_query(s).alias("m")).select("page_id", F.col("m")["Q"].alias("q"), F.col("m")["TITLE"].alias("title"))


@query(f"""WITH d AS (SELECT len({terms_sql('text')}) AS dl FROM documents), o AS (SELECT dl, row_number() OVER (ORDER BY dl) - 1 AS i, count(*) OVER () // 100 AS step FROM d)
SELECT i // step AS p, dl AS value FROM o WHERE step > 0 AND i % step = 0 AND i // step < 100""")
def q_percentiles_dl(spark, sf_dir):
    return evaluate.nearest_ranks(documents(spark, sf_dir).doc_len.select(F.col("dl").cast("long").alias("dl")), "dl")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def q_distinct_ids(spark, sf_dir):
    return sets.distinct_members(table(spark, sf_dir, "events"), "user_id", "event_type").withColumnRenamed("n", "kinds")


@query("SELECT event_id, contains(props, '7') AS has, (event_id & 8) <> 0 AS bit, event_id | 4 AS with_bit, event_id & ~2 AS without_bit FROM events")
def q_contains_and_bits(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", sets.contains(F.col("props"), "7").alias("has"), sets.bit_is_set(i, 3).alias("bit"), sets.with_bit(i, 2).alias("with_bit"), sets.without_bit(i, 1).alias("without_bit"))


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn DESC, role DESC) AS turns, string_agg(role, ',' ORDER BY turn DESC, role DESC) AS roles FROM conversations GROUP BY ALL")
def q_sorted_arrays(spark, sf_dir):
    got = sets.sorted_arrays(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", descending=True)
    return got.select("conv_id", F.array_join(F.transform("turn", lambda x: x.cast("string")), ",").alias("turns"), F.array_join("role", ",").alias("roles"))


@query("SELECT p_partkey AS row_no, p_name AS name, p_type AS kind, CAST(p_size AS VARCHAR) AS size FROM part")
def q_csv_fields(spark, sf_dir):
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat_ws(",", quoted("p_name"), quoted("p_type"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), csv_fields(record, ["name", "kind", "size"]).alias("f")).select("row_no", "f.*")


@query("SELECT count(*) AS n, true AS grouped FROM orders")
def q_row_groups(spark, sf_dir):
    return parquet_row_groups(spark, f"{sf_dir}/orders.parquet").agg(F.sum("rows").alias("n"), (F.count(F.lit(1)) > 0).alias("grouped"))


# --- the index as one object -----------------------------------------------------------------------------------------


def _facade(spark, sf_dir) -> SearchIndex:
    kept = _built.setdefault(spark, {})
    if (sf_dir, "facade") not in kept:
        kept[sf_dir, "facade"] = SearchIndex.from_dataframe(spark, table(spark, sf_dir, "part"), ["p_name", "P_TYPE"], "p_partkey").persist()
    return kept[sf_dir, "facade"]


_AS_TEXT = ", ".join(f'CAST(d.{c} AS VARCHAR) AS "{c.upper()}"' for c in ("p_partkey", "p_name", "p_type", "p_size"))


@query(search_sql("part", "p_partkey", PART, COLD, k=15, select=", ".join(f'd.{c} AS "{c.upper()}"' for c in _PART_COLUMNS) + ', best.score AS "SCORE"') + _PART_JOIN)
def q_facade_query(spark, sf_dir):
    return _facade(spark, sf_dir).query(COLD_TEXTS, {"P_NAME": 2.0}, 15)


@query(search_sql("part", "p_partkey", PART, COLD, k=15))
def q_facade_ids(spark, sf_dir):
    """From a saved index that is opened again."""
    saved = _facade(spark, sf_dir).save(scratch(spark, "facade"))
    return SearchIndex.load(spark, saved).query_ids(COLD_TEXTS, {"p_name": 2.0}, 15)


@query(search_sql("part", "p_partkey", PART, [("P_NAME", "COLD", 1.0), ("P_NAME", "WIDGET", 1.0)], select=f"{_AS_TEXT}, printf('%.4f', round(best.score, 4)) AS \"SCORE\"") + _PART_JOIN)
def q_facade_json(spark, sf_dir):
    """The service's answer to a query string, taken apart again."""
    answer = json.loads(_facade(spark, sf_dir).search_json("P_NAME=cold+wid%67et&SCORE=9"))["results"]
    names = ("P_PARTKEY", "P_NAME", "P_TYPE", "P_SIZE", "SCORE")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in answer], ", ".join(f"{n} string" for n in names))


@query("SELECT row_number() OVER () - 1 AS i, upper(column_name) AS name, column_name IN ('p_name', 'p_type') AS searched, (SELECT count(*) FROM part) AS n_docs FROM (DESCRIBE part)")
def q_facade_columns(spark, sf_dir):
    index = _facade(spark, sf_dir)
    return spark.createDataFrame([(i, n, n in index.search_columns(), index.n_docs()) for i, n in enumerate(index.columns())], "i long, name string, searched boolean, n_docs long")


@query(f"WITH {index_sql('part', 'p_partkey', {'p_name': 'p_name'})} SELECT term AS key, df AS score FROM dfs WHERE starts_with(term, 'W') ORDER BY score DESC, key LIMIT 3")
def q_facade_suggest(spark, sf_dir):
    return _facade(spark, sf_dir).suggest("p_name", "w", 3)
