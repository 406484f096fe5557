"""The operators applied to the synthetic tables, one query each, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm._common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def crc32_mod(column: str, n: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards of near equal bytes, equal texts together."""
    from tamarisk.llm.shards import shard_by_size

    return shard_by_size(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


@query
def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document, learnt from six sevenths of them."""
    from tamarisk.llm import lm

    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), crc32_mod("doc_id", 7) == 2)


#: Key of the pseudonyms in these queries; in use it comes from a secret store.
PSEUDONYM_KEY = b"tamarisk demonstration key"


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal data and secrets, and what was replaced."""
    from tamarisk.llm import pii

    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("n_entities"), "entities")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    import public_tokenizers

    from tamarisk.llm import bpe

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    back = bpe.decode(ids, path, pattern)
    return back.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded_bytes", 256).alias("decoded_sha256"))


@query
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-word passages that start in an earlier one too."""
    from tamarisk.llm import substrings

    found = substrings.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    from tamarisk.llm import neardup

    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows found for every fiftieth embedding."""
    from tamarisk.llm import ann

    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learnt from the labelled documents outside the held-out part."""
    from tamarisk.llm import quality

    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))  # a null doc_id is not held out
    found = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences and notices that whole documents, or lines of them, are."""
    from tamarisk.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))


@query
def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document lies inside windows of benchmark items."""
    from tamarisk.llm import decontam

    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


@query
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, from four rounds over 256 entries a part."""
    from tamarisk.llm import codes

    return codes.compress(table(spark, sf_dir, "embeddings"))


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and the component of fingerprints that differ in three bits or fewer."""
    from tamarisk.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of two and three words of each language."""
    from tamarisk.llm import phrases

    return phrases.collocations(table(spark, sf_dir, "documents"), best=2000)


ORACLE["op10_decontam"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT s.doc_id, s.i, s.n, v.item_id FROM s JOIN v ON s.win = v.win AND s.n = v.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _license_sql() -> str:
    from tamarisk.llm import licenses as l

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(k, v) for k, v in l.TEXTS.items()] + l.full_texts() + [(k, form.format(name)) for k, names in l.NAMES.items() for name in names for form in l.NOTICES]
    rows = sorted(set(rows))

    def digest(x: str) -> str:
        # a word that goes on as `copyright notice` is marked while lines that begin with the bare word are taken out
        x = rf"regexp_replace(lower({x}), 'copyright([ \t]+(?:notices?|holders?|owners?|interests?|laws?)\b)', 'copy~~right\1', 'g')"
        x = rf"regexp_replace({x}, '(^|\n)[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*(copyright|\(c\)|©)[^\n]*', '\1', 'g')"
        x = rf"regexp_replace(replace({x}, 'copy~~right', 'copyright'), '(^|[.:;])([\x00-\x2D\x2F\x3C-\x60\x7B-\x7F]*)\b[0-9]{{1,2}}[.)]([ \t\r\n])', '\1\2\3', 'g')"
        for a, b in l.SPELLINGS:
            x = f"replace({x}, {quote(a)}, {quote(b)})"
        return rf"sha256(trim(regexp_replace({x}, '{l._PUNCTUATION}', ' ', 'g')))"

    return f"""
WITH k AS (SELECT digest, min(license) AS license FROM (SELECT license, {digest('text')} AS digest FROM (VALUES {', '.join(f'({quote(a)}, {quote(b)})' for a, b in rows)}) AS t(license, text)) GROUP BY digest),
w AS (SELECT doc_id, license AS whole_license FROM (SELECT doc_id, {digest("coalesce(text, '')")} AS digest FROM documents) LEFT JOIN k USING (digest)),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
  FROM (SELECT doc_id, {digest('line')} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) JOIN k USING (digest) GROUP BY doc_id)
SELECT doc_id, whole_license, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines, coalesce(names, '') AS line_licenses FROM w LEFT JOIN n USING (doc_id)
"""


ORACLE["op6_licenses"] = _license_sql()


ORACLE["op7_neardup"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ')) AS s, least(5, len(w)) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v WHERE r.root < e.b
), m AS (SELECT v, min(root) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id
"""


ORACLE["op5_substrings"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT win, min(doc_id) AS least FROM s GROUP BY win
), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (win) WHERE doc_id > least
), u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), k AS (
  SELECT u.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY u.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.p = u.p GROUP BY u.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


ORACLE["op13_phrases"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), g AS MATERIALIZED (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m) GROUP BY lang, m, phrase
), n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang
), c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 10
), k AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), s AS (
  SELECT k.lang, k.m, k.phrase, a, k, x.f AS l, y.f AS r, CAST(a AS HUGEINT) * a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM k JOIN g x ON x.lang = k.lang AND x.phrase = k.x JOIN g y ON y.lang = k.lang AND y.phrase = k.y
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s
), z AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3
), y AS (SELECT lang, phrase, max(a) AS longer FROM z GROUP BY lang, phrase
), f AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN y ON y.lang = b.lang AND y.phrase = b.phrase WHERE cut = 1 AND (longer IS NULL OR 100 * longer < 50 * a)
)
SELECT f.lang, rank, f.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM f JOIN n ON n.lang = f.lang WHERE rank <= 2000
"""


def _codes_sql() -> str:
    """Four rounds over codebooks of 256 entries, written out; vectors without a length that four divides are beyond it."""
    nearest = """
a{i} AS MATERIALIZED (
  SELECT id, p, arg_min(j, d * 256 + j) AS j, min(d) AS d
  FROM (SELECT x.id, x.p, c.j, CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) AS d FROM x JOIN c{i} c ON c.p = x.p) GROUP BY id, p
)"""
    update = """
t{i} AS (
  SELECT p, j, q, sum(CAST(y AS HUGEINT)) AS s, count(*) AS n
  FROM (SELECT x.p, a.j, unnest(x.v) AS y, unnest(range(1, len(x.v) + 1)) AS q FROM x JOIN a{i} a ON a.id = x.id AND a.p = x.p) GROUP BY p, j, q
), m{i} AS (SELECT p, j, list(CAST((s - ((s % n + n) % n)) // n AS DOUBLE) ORDER BY q) AS v FROM t{i} GROUP BY p, j
), c{k} AS MATERIALIZED (SELECT c.p, c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.j = c.j)"""
    steps = ",".join(nearest.format(i=i) + "," + update.format(i=i, k=i + 1) for i in range(4)) + "," + nearest.format(i=4)
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda y: floor(1024 * CAST(y AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), x AS MATERIALIZED (SELECT id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM (SELECT id, v, unnest(range(4)) AS p FROM e)
), c0 AS MATERIALIZED (SELECT p, id - 1 AS j, v FROM x WHERE id <= 256),{steps},
o AS (SELECT id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY id
), h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN o USING (id), h
"""


ORACLE["op11_codes"] = _codes_sql()
