"""The operators over the given tables, whole, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countercheck.llm import audit, bpe, collocations, forest, licenses, mixing, neighbours, passages, pii, quality, shards, simhash, urls
from countercheck.llm.support import table

Query = Callable[[SparkSession, str], DataFrame]


def digests(docs: DataFrame, *columns: str, ids: bool = False) -> DataFrame:
    """Token counts and digests of ids and decoded text, beside some columns of the documents."""
    both = bpe.round_trip(docs.select(*columns, "text"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        *columns,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *(["ids"] if ids else []),
    )


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), "doc_id")


FIRST_DAY = "2024-01-01"


def _number(text: Column) -> Column:
    """0 to 65535 from a text, as the SQL below has it."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def dated_lists(pages: DataFrame) -> DataFrame:
    """Entries for hosts, domains and path prefixes of the pages, by a rule on their names.

    The tables hold no lists. About a third of the names is blocked from some
    day on and a quarter of the others allowed; half of those are removed later,
    and some of them added again.
    """
    host, labels = urls.host_of(F.col("url")), F.split(urls.host_of(F.col("url")), r"\.")
    segments = F.filter(F.split(urls.path_of(F.col("url")), "/"), lambda s: s != "")

    def name(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    def last(n: int) -> Column:
        return F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."))

    prefix = F.when(F.size(segments) >= 1, F.concat_ws("/", host, F.get(segments, F.lit(0))))
    names = F.array(name("host", host), name("domain", last(2)), name("domain", last(3)), name("prefix", prefix))
    names = pages.filter(host.isNotNull()).select(F.explode(names).alias("n")).select("n.*").filter("key is not null")
    names = names.distinct().withColumn("x", _number(F.concat_ws(":", "kind", "key")))
    names = names.withColumn("list", F.when(F.col("x") % 3 == 0, "block").when(F.col("x") % 4 == 1, "allow"))
    start, x = F.col("x") % 200, F.col("x")
    first = F.struct(start.alias("after"), F.lit("add").alias("action"))
    gone = F.when(x % 2 == 0, F.struct((start + 40 + x % 50).alias("after"), F.lit("remove").alias("action")))
    again = F.when(x % 10 == 0, F.struct((start + 100 + x % 50).alias("after"), F.lit("add").alias("action")))
    events = names.filter("list is not null").select("list", "kind", "key", F.explode(F.array_compact(F.array(first, gone, again))).alias("e"))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("e.after"))
    return events.select("list", "kind", "key", day.alias("day"), F.col("e.action").alias("action"))


def op2_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    captured = F.date_add(F.lit(FIRST_DAY).cast("date"), _number(F.col("page_id").cast("string")) % 366)
    out = urls.filter_urls(pages.withColumn("day", captured), dated_lists(pages))
    dates = [F.col(c).cast("string").alias(c) for c in ("day", "valid_from", "valid_to")]
    return out.select("page_id", "host", *dates, "decision", "entry_kind", "entry_key")


_URL = "'" + urls.URL + "'"
OP2_SQL = f"""
WITH parts AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, {_URL}, 1)), '.'), '') AS host,
         [s FOR s IN string_split(regexp_extract(url, {_URL}, 2), '/') IF s <> ''] AS segments,
         DATE '{FIRST_DAY}' + ('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4))::INT % 366 AS day
  FROM pages),
labels AS (SELECT *, string_split(host, '.') AS l FROM parts WHERE host IS NOT NULL),
names AS (
  SELECT 'host' AS kind, host AS key FROM labels
  UNION SELECT 'domain', array_to_string(l[len(l) - 1:], '.') FROM labels WHERE len(l) >= 2
  UNION SELECT 'domain', array_to_string(l[len(l) - 2:], '.') FROM labels WHERE len(l) >= 3
  UNION SELECT 'prefix', host || '/' || segments[1] FROM labels WHERE len(segments) >= 1),
listed AS (
  SELECT *, CASE WHEN x % 3 = 0 THEN 'block' ELSE 'allow' END AS list
  FROM (SELECT *, ('0x' || substr(md5(kind || ':' || key), 1, 4))::INT AS x FROM names)
  WHERE x % 3 = 0 OR x % 4 = 1),
spans AS (
  SELECT list, kind, key, DATE '{FIRST_DAY}' + x % 200 AS valid_from,
         CASE WHEN x % 2 = 0 THEN DATE '{FIRST_DAY}' + (x % 200 + 40 + x % 50) ELSE DATE '9999-12-31' END AS valid_to
  FROM listed
  UNION ALL
  SELECT list, kind, key, DATE '{FIRST_DAY}' + (x % 200 + 100 + x % 50), DATE '9999-12-31'
  FROM listed WHERE x % 10 = 0),
hits AS (
  SELECT p.page_id, s.*, CASE kind WHEN 'domain' THEN len(string_split(key, '.')) WHEN 'host' THEN 1000
                         ELSE 2000 + len(string_split(key, '/')) - 1 END AS weight
  FROM parts p JOIN spans s ON p.day >= s.valid_from AND p.day < s.valid_to AND (
    (kind = 'host' AND host = key)
    OR (kind = 'domain' AND ends_with('.' || host, '.' || key))
    OR (kind = 'prefix' AND starts_with(host || '/' || array_to_string(segments, '/') || '/', key || '/')))),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, list, kind, key, valid_from) AS n FROM hits)
SELECT p.page_id, p.host, CAST(p.day AS VARCHAR) AS day, CAST(valid_from AS VARCHAR) AS valid_from,
       CAST(valid_to AS VARCHAR) AS valid_to, coalesce(list, 'none') AS decision,
       kind AS entry_kind, key AS entry_key
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND n = 1
"""


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def held_out() -> Column:
    """Whether a document's label is kept from training; not for a null key."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_quality(spark: SparkSession, folder: str, docs: DataFrame):
    """Weights from the labels whose keys are not held out."""
    return quality.train(docs, table(spark, folder, "labels").filter(~held_out()))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, learn_quality(spark, folder, docs))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = shards.assign(table(spark, folder, "documents"), ["doc_id"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def op6_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(table(spark, folder, "embeddings"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(pii.spans_text(F.col("pii base")), 256).alias("base_sha256"),
        pii.spans_text(F.col("pii spans")).alias("spans"),
    )


def op8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), ["doc_id"])


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM places, (SELECT unnest(range(1, 5)) AS size) WHERE i + size - 1 <= len(w)),
counts AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM found),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, l.f AS l, r.f AS r, k, (2000000 * c.f) // (l.f + r.f) AS score
  FROM cuts c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM found b WHERE b.lang = s.lang AND b.size > s.size AND 100 * b.f >= 80 * s.a
      AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Base places and labels, and those of the templates; score 1 for a whole template, 0.5 for a base phrase alone."""
    found = licenses.find(table(spark, folder, "documents").select("doc_id", "text"))
    places = F.col("license places")
    base = F.filter(places, lambda p: ~p["template"])
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id",
        F.col("license words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.label_text(base).alias("base_labels"),
        licenses.label_text(places).alias("labels"),
        F.when(F.exists(places, lambda p: p["template"]), 1.0).when(F.size(places) > 0, 0.5).otherwise(0.0).alias("score"),
    )


_PHRASES = ", ".join(f"('{p}', {p.split()!r}, '{label}')" for p, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join(f"(' {licenses.pattern(t)}', '{label}')" for label, t in licenses.TEMPLATES)
OP12_SQL = rf"""
WITH phrases(phrase, p, label) AS (VALUES {_PHRASES}),
templates(wording, label) AS (VALUES {_TEMPLATES}),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, label, i - 1 AS start
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs), phrases
  WHERE w[i:i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         list_sort(list_distinct(list(label))) AS found
  FROM places GROUP BY doc_id),
more AS (
  SELECT doc_id, list(label) AS found FROM docs, templates
  WHERE regexp_matches(' ' || array_to_string(w, ' ') || ' ', wording) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b.found, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.found, m.found))), ','), '') AS labels,
       CASE WHEN m.found IS NOT NULL THEN 1.0 WHEN b.found IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM docs LEFT JOIN base b USING (doc_id) LEFT JOIN more m USING (doc_id)
"""


def op13_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP13_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
  FROM words LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, good, toxic, failed, count(*) AS n FROM fails GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, step, o[step] AS filter, left(o, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, o, step, filter,
         sum(CASE WHEN translate(before || filter, failed, '') = before || filter THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(failed, filter) AND translate(before, failed, '') = before THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(failed, filter) AND translate(before, failed, '') <> before THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = filter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN good AND contains(failed, filter) AND translate(before, failed, '') = before THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN toxic AND contains(failed, filter) AND translate(before, failed, '') = before THEN n ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, o, step, filter)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_bpe": (op1_bpe, None),
    "op2_urls": (op2_urls, OP2_SQL),
    "op3_nearest": (op3_nearest, None),
    "op4_quality": (op4_quality, None),
    "op5_shards": (op5_shards, None),
    "op6_forest": (op6_forest, None),
    "op7_pii": (op7_pii, None),
    "op8_mix": (op8_mix, None),
    "op9_simhash": (op9_simhash, None),
    "op10_passages": (op10_passages, None),
    "op11_collocations": (op11_collocations, OP11_SQL),
    "op12_licenses": (op12_licenses, OP12_SQL),
    "op13_audit": (op13_audit, OP13_SQL),
}
