"""Scalar functions, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as TM
from ..functions import url as U
from ..operators import validation as V
from ..sources.records import now, records, table
from .registry import query

_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(_quoted(x) for x in xs) + "]"
#: Sentences that the classifier and the entity patterns know, added to the records' own texts.
PHRASES = (
    "docker and python on ubuntu with an RTX 3090", "I always prefer a concise tone and never use tabs", "error: crash, timeout, out of memory; Docker 24.0 at db.internal:5432",
    "the agent must not fail; you are called bot", "working on this task in the current session with qwen-2.5", "nothing to see",
)
_PHRASE_SQL = f"{_list(PHRASES)}[CAST(uuid % {len(PHRASES)} AS INTEGER) + 1]"


def _phrased(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("uuid") % len(PHRASES)).cast("int") + 1)
    return records(spark, d, vectors=False).withColumn("said", F.concat(F.col("content"), F.lit(" "), phrase))


@query("tokenize", r"SELECT uuid, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS tokens FROM mem")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, vectors=False).select("uuid", T.tokens(F.col("content")).alias("tokens"))


@query("jaccard_keywords", """
WITH p AS (SELECT a.uuid AS a, b.uuid AS b, a.keywords AS ka, b.keywords AS kb FROM mem a JOIN mem b ON b.uuid = a.uuid + 1)
SELECT a, b, CASE WHEN len(ka) > 0 AND len(kb) > 0 THEN round(len(list_intersect(ka, kb))::DOUBLE / len(list_distinct(list_concat(ka, kb))), 6) END AS jaccard FROM p""")
def jaccard_keywords(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d).select(F.col("uuid").alias("a"), F.col("keywords").alias("ka"))
    b = records(spark, d).select(F.col("uuid").alias("b"), F.col("keywords").alias("kb"), (F.col("uuid") - 1).alias("a"))
    return a.join(b, "a").select("a", "b", F.round(T.jaccard(F.col("ka"), F.col("kb")), 6).alias("jaccard"))


_UNION = " UNION ALL ".join(f"SELECT uuid, data_type AS given, {i} AS o, {_quoted(k)} AS k, {_quoted(n)} AS n, len(regexp_extract_all(said, {_quoted(p)})) AS c FROM s" for i, (k, n, p) in enumerate(T.HEURISTICS))
_CLASS = f"WITH s AS (SELECT uuid, data_type, lower(concat(content, ' ', {_PHRASE_SQL})) AS said FROM mem), h AS ({_UNION}), b AS (SELECT uuid, given, k, n, c FROM h QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY c DESC, o) = 1)"


@query("heuristic_classify", f"{_CLASS} SELECT uuid, CASE WHEN c > 0 THEN k ELSE 'CUSTOM' END AS data_type, CASE WHEN c > 0 THEN n END AS data_id, CASE WHEN c > 0 THEN round(least(c / 3.0::DOUBLE, 1), 6) ELSE 0 END AS confidence FROM b")
def heuristic_classify(spark: SparkSession, d: str) -> DataFrame:
    best = F.col("best")
    rows = _phrased(spark, d).select("uuid", T.heuristic_class(F.col("said")).alias("best"))
    return rows.select("uuid", F.coalesce(best["data_type"], F.lit("CUSTOM")).alias("data_type"), best["data_id"].alias("data_id"), F.when(best.isNull(), 0.0).otherwise(F.round(F.least(best["n"] / 3.0, F.lit(1.0)), 6)).alias("confidence"))


@query("resolve_type", f"{_CLASS} SELECT uuid, CASE WHEN given <> 'CUSTOM' THEN given WHEN c / 3.0 >= 0.6 THEN k ELSE 'CUSTOM' END AS data_type FROM b")
def resolve_type(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("uuid", T.resolved_type(F.col("data_type"), T.heuristic_class(F.col("said"))).alias("data_type"))


def _entity_sql() -> str:
    rules = []
    for name, pattern, any_case in T.ENTITIES:
        x = f"list_filter(list_transform(regexp_extract_all(said, {_quoted(('(?i)' if any_case else '') + pattern)}), lambda x: trim(x)), lambda x: x <> '')"
        if name == "software_versions":
            x = f"list_filter({x}, lambda x: NOT list_contains({_list(T.ENTITY_STOP)}, lower(regexp_split_to_array(x, '\\s+')[1])))"
        if name == "service_hostnames":
            x = f"list_filter({x}, lambda x: length(x) >= 5 AND NOT regexp_matches(x, '\\.(com|net|org|io|dev)$'))"
        rules.append(x)
    return f"list_concat({', '.join(rules)})"


@query("extract_entities", f"""WITH s AS (SELECT uuid, concat(content, ' ', {_PHRASE_SQL}) AS said FROM mem), e AS (SELECT uuid, {_entity_sql()} AS x FROM s)
SELECT uuid, list_filter(x, lambda v, i: list_position(x, v) = i)[1:15] AS entities FROM e""")
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("uuid", T.entities(F.col("said")).alias("entities"))


@query("merge_entities", f"""WITH s AS (SELECT uuid, keywords, concat(content, ' ', {_PHRASE_SQL}) AS said FROM mem), e AS (SELECT uuid, keywords, {_entity_sql()} AS x FROM s),
m AS (SELECT uuid, list_concat(keywords, list_filter(x, lambda v, i: list_position(x, v) = i)[1:15]) AS w FROM e), l AS (SELECT uuid, w, list_transform(w, lambda v: lower(v)) AS low FROM m)
SELECT uuid, list_filter(w, lambda v, i: list_position(low, lower(v)) = i) AS keywords FROM l""")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("uuid", T.merge_folded(F.col("keywords"), T.entities(F.col("said"))).alias("keywords"))


TTLS = ("12h", "3 d", "2w", "1 m", "2026-02-03 04:05:06", "soon", "")


@query("ttl_normalise", f"""WITH t AS (SELECT uuid, {_list(TTLS)}[CAST(uuid % 7 AS INTEGER) + 1] AS s FROM mem), p AS (SELECT uuid, s, regexp_extract(s, '^\\s*([0-9]{{1,6}})\\s*([hdwm])\\s*$', 1) AS n, regexp_extract(s, '^\\s*([0-9]{{1,6}})\\s*([hdwm])\\s*$', 2) AS u FROM t)
SELECT uuid, CASE WHEN u <> '' THEN TIMESTAMP '2026-01-01 00:00:00' + to_hours(try_cast(n AS INTEGER) * CASE u WHEN 'h' THEN 1 WHEN 'd' THEN 24 WHEN 'w' THEN 168 ELSE 720 END) ELSE try_cast(s AS TIMESTAMP) END AS ttl FROM p""")
def ttl_normalise(spark: SparkSession, d: str) -> DataFrame:
    given = F.element_at(F.array(*map(F.lit, TTLS)), (F.col("uuid") % 7).cast("int") + 1)
    return records(spark, d, vectors=False).select("uuid", TM.ttl(given, now()).alias("ttl"))


STAMPS = ("2025-05-05 01:02:03", "2027-01-01 00:00:00", "yesterday", "")


@query("import_repair_ts", f"""WITH t AS (SELECT uuid, try_cast({_list(STAMPS)}[CAST(uuid % 4 AS INTEGER) + 1] AS TIMESTAMP) AS t0 FROM mem)
SELECT uuid, CASE WHEN t0 IS NULL OR t0 > TIMESTAMP '2026-01-01 00:00:00' THEN TIMESTAMP '2026-01-01 00:00:00' ELSE t0 END AS created_at FROM t""")
def import_repair_ts(spark: SparkSession, d: str) -> DataFrame:
    given = F.element_at(F.array(*map(F.lit, STAMPS)), (F.col("uuid") % 4).cast("int") + 1)
    return records(spark, d, vectors=False).select("uuid", V.repaired_time(given, now()).alias("created_at"))


_DAYS = "floor(epoch(TIMESTAMP '2026-01-01 00:00:00' - created_at) / 86400.0)"
RECENCY_SQL = f"CASE WHEN priority >= 3 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + {_DAYS} * (1.0::DOUBLE / (21.0::DOUBLE * 0.6931471805599453::DOUBLE))) END"


@query("recency", f"SELECT uuid, round({RECENCY_SQL}, 6) AS recency FROM mem")
def recency(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, vectors=False).select("uuid", F.round(TM.recency(F.col("created_at"), now(), F.col("priority") >= 3), 6).alias("recency"))


@query("canonical_url", r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h,
 regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_aggregate(list_filter(string_split(q, '&'), lambda x: contains(x, '=') AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','fbclid','gclid','mc_eid'], lower(string_split(x, '=')[1]))), 'string_agg', '&') AS kept FROM p)
SELECT page_id, concat(s, '://', h, CASE WHEN p = '' THEN '/' ELSE p END, CASE WHEN coalesce(kept, '') <> '' THEN concat('?', kept) ELSE '' END) AS url FROM k""", mem=False)
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("url"))


@query("tags_normalise", r"SELECT page_id, regexp_replace(lower(trim(concat(' ', regexp_extract(html, '<title>([^<]*)', 1), ' '))), '\s+', '-', 'g') AS tag FROM pages", mem=False)
def tags_normalise(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, d, "pages").select("page_id", T.tag(title).alias("tag"))


@query("safe_title", r"SELECT page_id, regexp_replace(lower(trim(left(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[^\p{L}\p{N}_\s-]', '', 'g'), 50))), '[\s_]+', '-', 'g') AS stem FROM pages", mem=False)
def safe_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.file_stem(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("stem"))


@query("summary_derived", r"""SELECT uuid, left(sha256(content), 16) AS content_hash, len(list_filter(regexp_split_to_array(trim(content), '\s+'), lambda x: x <> '')) AS token_estimate,
 CASE WHEN length(content) > 500 THEN 'full' ELSE 'partial' END AS coverage_status FROM mem""")
def summary_derived(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("content")
    return records(spark, d, vectors=False).select("uuid", F.substring(F.sha2(text, 256), 1, 16).alias("content_hash"), T.word_count(text).alias("token_estimate"), F.when(F.length(text) > 500, "full").otherwise("partial").alias("coverage_status"))


@query("wikilinks", r"SELECT uuid, regexp_extract_all(concat('see [[', topic, ']] and [[', data_id, '|x]]'), '\[\[([^\]]+)\]\]', 1) AS links FROM mem")
def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, vectors=False).select("uuid", T.wikilinks(F.concat(F.lit("see [["), "topic", F.lit("]] and [["), "data_id", F.lit("|x]]"))).alias("links"))


ASKED = ("what are we missing", "last week", "postgres port", "compare redis versus memcached latency figures", "which decisions about deployment changed this summer")
_ASKED_SQL = f"concat({_list(ASKED)}[CAST(item_id % 5 AS INTEGER) + 1], CASE WHEN item_id % 2 = 0 THEN concat(' ', text) ELSE '' END)"


@query("suggest_layer", rf"""WITH q AS (SELECT item_id, lower({_ASKED_SQL}) AS q FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(q, '\b(missing|gap|what else|what are we missing|not covered)\b') THEN 4
 WHEN len(list_filter(regexp_extract_all(q, '\b[a-z]{{3,}}\b'), lambda w: NOT list_contains({_list(T.SUGGEST_STOP)}, w))) <= 2 THEN 2
 WHEN regexp_matches(q, '\b(last|this|recent|next)\s+(week|month|year|quarter|spring|summer|fall|winter)\b') THEN 2 ELSE 3 END AS depth FROM q""", mem=False)
def suggest_layer(spark: SparkSession, d: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("item_id") % 5).cast("int") + 1)
    text = F.when(F.col("item_id") % 2 == 0, F.concat(asked, F.lit(" "), F.col("text"))).otherwise(asked)
    return table(spark, d, "benchmark").select("item_id", T.suggested_depth(text).alias("depth"))


FIELDS = ('["a","b"]', "plain", "", '{"k":1}', "[1,")


@query("json_repair", f"""WITH f AS (SELECT uuid, {_list(FIELDS)}[CAST(uuid % 5 AS INTEGER) + 1] AS s FROM mem)
SELECT uuid, CASE WHEN json_valid(s) AND json_type(s) = 'ARRAY' THEN from_json(s, '["VARCHAR"]') WHEN s = '' OR left(s, 1) IN ('[', '{{') THEN [] ELSE [s] END AS list,
 CASE WHEN json_valid(s) AND json_type(s) = 'OBJECT' THEN s ELSE '{{}}' END AS object FROM f""")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    given = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("uuid") % 5).cast("int") + 1)
    return records(spark, d, vectors=False).select("uuid", V.repaired_list(given).alias("list"), V.repaired_object(given).alias("object"))


@query("fence_untrusted", f"""SELECT uuid, CASE WHEN source IN ('agent', 'consolidated', 'user-stated') THEN concat(topic, '{T.FENCE_CLOSE}')
 ELSE concat('{T.FENCE_OPEN}', topic, '{T.FENCE_CLOSE}') END AS text FROM mem""")
def fence_untrusted(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, vectors=False).select("uuid", T.fence(F.concat("topic", F.lit(T.FENCE_CLOSE)), F.col("source")).alias("text"))


_TOK = rf"list_filter(regexp_extract_all(lower(%s), '[\p{{L}}\p{{N}}]+(?:[-''.][\p{{L}}\p{{N}}]+)*'), lambda t: (length(t) >= 3 OR regexp_matches(t, '[0-9]')) AND NOT list_contains({_list(T.USER_STOP)}, t))"


@query("user_stated_exact", f"""WITH p AS (SELECT a.uuid, {_TOK % 'a.summary'} AS own, {_TOK % 'b.content'} AS said FROM mem a JOIN mem b ON b.uuid = a.uuid - a.uuid % 2)
SELECT uuid, coalesce(len(list_filter(own, lambda t: list_contains(said, t)))::DOUBLE / nullif(len(own), 0) >= 0.75 AND len(said) > 0, false) AS stated FROM p""")
def user_stated_exact(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d, vectors=False).select("uuid", "summary", (F.col("uuid") - F.col("uuid") % 2).alias("k"))
    b = records(spark, d, vectors=False).where("uuid % 2 = 0").select(F.col("uuid").alias("k"), F.col("content").alias("message"))
    return a.join(b, "k").select("uuid", F.coalesce(T.user_share(F.col("summary"), F.col("message")) >= 0.75, F.lit(False)).alias("stated"))


@query("uuid_dash", "WITH h AS (SELECT uuid, md5(CAST(uuid AS VARCHAR)) AS x FROM mem) SELECT uuid, concat(x[1:8], '-', x[9:12], '-', x[13:16], '-', x[17:20], '-', x[21:32]) AS dashed FROM h")
def uuid_dash(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, vectors=False).select("uuid", V.dashed(F.md5(F.col("uuid").cast("string").cast("binary"))).alias("dashed"))


@query("split_qualified", "WITH q AS (SELECT uuid, CASE WHEN uuid % 2 = 0 THEN concat(data_type, ':', data_id) ELSE data_type END AS s FROM mem) SELECT uuid, string_split(s, ':')[1] AS data_type, lower(string_split(s, ':')[2]) AS data_id FROM q")
def split_qualified(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("uuid") % 2 == 0, F.concat("data_type", F.lit(":"), "data_id")).otherwise(F.col("data_type"))
    kind, name = V.qualified(given)
    return records(spark, d, vectors=False).select("uuid", kind.alias("data_type"), name.alias("data_id"))


@query("import_clamps", """SELECT uuid, CASE WHEN uuid % 10 = 9 THEN 0.5 ELSE greatest(0, least(1, round(trust_score * 3 - 1, 4))) END AS trust, greatest(0, least(3, uuid % 9 - 2)) AS priority,
 greatest(0, least(3, uuid % 7 - 1)) AS sensitivity, greatest(0, uuid % 5 - 2) AS reference_count FROM mem""")
def import_clamps(spark: SparkSession, d: str) -> DataFrame:
    trust = F.when(F.col("uuid") % 10 == 9, F.lit(float("nan"))).otherwise(F.round(F.col("trust_score") * 3 - 1, 4))
    u = F.col("uuid")
    return records(spark, d, vectors=False).select("uuid", V.clamp_trust(trust).alias("trust"), V.clamp_level(u % 9 - 2).alias("priority"), V.clamp_level(u % 7 - 1).alias("sensitivity"), F.greatest(F.lit(0), u % 5 - 2).alias("reference_count"))


@query("validate_rows", """SELECT uuid, CASE WHEN coalesce(content, '') = '' THEN 'content is empty' WHEN length(content) > 50000 THEN 'content is longer than 50000' WHEN NOT regexp_matches(data_type, '^[A-Z][A-Z0-9_-]*$') THEN 'data_type is no name'
 WHEN len(keywords) > 200 THEN 'too many keywords' WHEN trust_score NOT BETWEEN 0 AND 1 THEN 'trust_score is out of range' END AS reason FROM mem""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, vectors=False).select("uuid", V.reject_reason().alias("reason"))


@query("classify_session", """WITH s AS (SELECT conv_id, count(*) AS m, count(*) FILTER (role = 'assistant') AS t, sum(length(text)) // 4 AS o FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN m <= 4 AND t <= 1 AND o <= 2000 THEN 'skip' WHEN conv_id % 5 = 0 OR m >= 10 OR t >= 5 OR o >= 5000 THEN 'important' ELSE 'medium' END AS class FROM s""", mem=False)
def classify_session(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("m"), F.count_if(F.col("role") == "assistant").alias("t"), F.floor(F.sum(F.length("text")) / 4).alias("o"))
    reason = F.when(F.col("conv_id") % 5 == 0, "compression")
    return rows.select("conv_id", V.session_class(F.col("m"), F.col("t"), F.col("o"), reason).alias("class"))


@query("session_name", "SELECT conv_id, CASE WHEN any_value(text) IS NULL THEN CAST(conv_id AS VARCHAR) ELSE concat(conv_id, ' :: ', replace(concat(arg_min(text, turn), ' :: x'), ' :: ', ' : ')) END AS name FROM conversations GROUP BY conv_id", mem=False)
def session_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    title = F.concat("t", F.lit(" :: x"))
    return rows.select("conv_id", V.session_name(F.col("conv_id"), title).alias("name"))


@query("redact_url", r"SELECT page_id, regexp_replace(regexp_replace(replace(concat(url, '&token=abc'), '://', '://u:pw@'), '://[^/@\s]+@', '://***@', 'g'), '(?i)((?:api[_-]?key|token|password)\s*=\s*)[^\s&]+', '\1***', 'g') AS url FROM pages", mem=False)
def redact_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.redacted(F.replace(F.concat("url", F.lit("&token=abc")), F.lit("://"), F.lit("://u:pw@"))).alias("url"))


@query("fixture_classify", r"""SELECT uuid, CASE WHEN lower(trim(regexp_replace(content, '\s+', ' ', 'g'))) IN (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) FROM benchmark) THEN 'exact'
 WHEN regexp_matches(lower(trim(regexp_replace(content, '\s+', ' ', 'g'))), '^the .* and .*$') THEN 'pattern' ELSE 'other' END AS kind FROM mem""")
def fixture_classify(spark: SparkSession, d: str) -> DataFrame:
    exact = table(spark, d, "benchmark").select(T.normalised(F.col("text")).alias("n"), F.lit(True).alias("hit")).distinct()
    rows = records(spark, d).select("uuid", T.normalised(F.col("content")).alias("n")).join(exact, "n", "left")
    return rows.select("uuid", F.when(F.col("hit"), "exact").when(F.col("n").rlike("^the .* and .*$"), "pattern").otherwise("other").alias("kind"))
