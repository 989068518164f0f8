"""Text queries over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..registry import query, table

_SPACES = r"[\s\x{00a0}\x{0085}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{000b}]+"
_CLEAN = rf"trim(regexp_replace(lower(text), '{_SPACES}', ' ', 'g'))"
_REDACT = rf"regexp_replace(regexp_replace(regexp_replace(§, '{text.EMAIL}', '{text.EMAIL_MARK}', 'g'), '{text.PHONE}', '{text.PHONE_MARK}', 'g'), '\d', 'X', 'g')"
_CUT = "list_transform([§], lambda r: CASE WHEN length(r) > 120 THEN substr(r, 1, 117) || '...' ELSE r END)[1]"


def fnv_sql(s: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split({s}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def md5_sql(s: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5({s}), 1, {digits}))::BIGINT"


@query(f"SELECT doc_id, {_CUT.replace('§', _REDACT.replace('§', 'text'))} AS redacted FROM documents")
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redacted(F.col("text")).alias("redacted"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS fingerprint FROM documents")
def text_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.short_digest(F.col("text")).alias("fingerprint"))


@query(f"SELECT conv_id, turn, CASE WHEN contains(lower(m), 'text=') OR contains(m, '@') THEN {_CUT.replace('§', _REDACT.replace('§', 'm'))} ELSE m END AS message FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'text=' || text ELSE text END AS m FROM conversations)")
def log_filter(spark, sf_dir):
    m = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("text="), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.log_safe(m).alias("message"))


@query(f"SELECT doc_id, sha256({_CLEAN}) AS clean_sha256, length({_CLEAN}) AS n FROM documents")
def normalise_text(spark, sf_dir):
    clean = text.normalised(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean.cast("binary"), 256).alias("clean_sha256"), F.length(clean).cast("long").alias("n"))


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '\d', 'X', 'g')) AS masked_sha256 FROM documents")
def mask_digits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.digits_masked(F.col("text")).cast("binary"), 256).alias("masked_sha256"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"SELECT doc_id, len({_WORDS}) AS n_words, len(list_distinct({_WORDS})) AS n_distinct FROM documents")
def word_tokens(spark, sf_dir):
    w = text.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query(r"SELECT doc_id, sha256(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w, i: i % 4 <> 3), ' ')) AS thinned_sha256 FROM documents")
def word_thinning(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.thinned(F.col("text")).cast("binary"), 256).alias("thinned_sha256"))


_GRAMS = f"""WITH c AS (SELECT doc_id, text, clean, list_filter(string_split(clean, ''), lambda x: x <> '') AS c FROM (SELECT doc_id, text, {_CLEAN} AS clean FROM documents)),
g AS (SELECT doc_id, text, unnest(list_concat(list_filter(string_split(clean, ' '), lambda w: w <> ''), {', '.join(f"list_transform(range(1, greatest(len(c) - {n - 2}, 1)), lambda i: {' || '.join(f'c[i + {k}]' for k in range(n))})" for n in (3, 4, 5))})) AS gram FROM c)"""


@query(_GRAMS + " SELECT doc_id, count(*) AS n, count(DISTINCT gram) AS n_distinct FROM g GROUP BY doc_id")
def char_ngrams(spark, sf_dir):
    """Numbers of words and n-grams, and of different ones, of each document that has any."""
    return text.gram_numbers(table(spark, sf_dir, "documents")).where("n > 0")


_CUE_ROWS = " UNION ALL ".join([f"SELECT doc_id, {i} AS slot, {text.CUE_WEIGHT}::DOUBLE AS weight FROM documents WHERE contains(lower(text), '{c}')" for i, c in enumerate(text.CUES)] + [f"SELECT doc_id, {slot} AS slot, {w}::DOUBLE AS weight FROM documents WHERE regexp_matches(text, '{p}')" for p, slot, w in text.PATTERN_CUES])


@query(f"SELECT doc_id, slot::INTEGER AS slot, sum(weight)::DOUBLE AS weight FROM ({_CUE_ROWS}) GROUP BY ALL")
def pii_cues(spark, sf_dir):
    return text.cues(table(spark, sf_dir, "documents"))


@query(f"""{_GRAMS}, h AS (SELECT doc_id, {md5_sql(f"'{text.SEED}:' || gram")} AS h FROM g),
v AS (SELECT doc_id, (h % {text.DIM})::INTEGER AS slot, CASE WHEN (h // {text.DIM}) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS value FROM h UNION ALL SELECT doc_id, slot::INTEGER, weight FROM ({_CUE_ROWS})),
s AS (SELECT doc_id, slot, sum(value) AS value FROM v GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(value * value)) AS norm FROM s GROUP BY doc_id)
SELECT doc_id, slot, round(CASE WHEN norm > 0 THEN value / norm ELSE 0 END, 6) + 0.0 AS value FROM s JOIN n USING (doc_id)""")
def hash_features(spark, sf_dir):
    rows = text.hashed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "slot", (F.round("value", 6) + 0.0).alias("value"))


@query()
def hash_features_blake(spark, sf_dir):
    rows = text.hashed(table(spark, sf_dir, "documents"), exact=True)
    return rows.select("doc_id", "slot", (F.round("value", 6) + 0.0).alias("value"))


_TITLE = "regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"


@query(f"SELECT page_id, {fnv_sql(_TITLE)} AS h FROM pages")
def fnv1a_title(spark, sf_dir):
    """Hash of each page's title."""
    title = F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", hashing.fnv1a(title).alias("h"))


@query(f"SELECT doc_id, {fnv_sql('text')} AS h FROM documents")
def fnv1a_document(spark, sf_dir):
    """Hash of each document's whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", hashing.fnv1a(F.col("text")).alias("h"))


@query(f"SELECT p_partkey, {fnv_sql('p_name')} AS h FROM part")
def fnv1a(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.fnv1a(F.col("p_name")).alias("h"))


_LCG = lambda x: f"(({x} * 1664525 + 1013904223) & 4294967295)"


@query(f"SELECT p_partkey, {_LCG('p_partkey')} AS x1, {_LCG(_LCG('p_partkey'))} AS x2, {_LCG(_LCG(_LCG('p_partkey')))} AS x3 FROM part")
def lcg_stream(spark, sf_dir):
    x1 = hashing.lcg(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", x1.alias("x1"), hashing.lcg(x1).alias("x2"), hashing.lcg(hashing.lcg(x1)).alias("x3"))


@query(f"""WITH h AS (SELECT p_partkey, {fnv_sql('p_partkey::VARCHAR')} AS h0 FROM part), a AS (SELECT *, {_LCG('h0')} AS h1 FROM h), b AS (SELECT *, {_LCG('h1')} AS h2 FROM a), c AS (SELECT *, {_LCG('h2')} AS h3 FROM b), d AS (SELECT *, {_LCG('h3')} AS h4 FROM c),
u AS (SELECT p_partkey, CASE WHEN h1 / 4294967296.0::DOUBLE > 0.5 THEN 1 ELSE -1 END AS side, h2 / 4294967296.0::DOUBLE * pi() * 2 AS theta, h3 / 4294967296.0::DOUBLE * 2 - 1 AS z, cbrt(h4 / 4294967296.0::DOUBLE) AS r FROM d)
SELECT p_partkey, round(side * 0.95::DOUBLE + cos(theta) * sqrt(1 - z * z) * r * 1.32::DOUBLE, 6) AS x, round(0.15::DOUBLE + sin(theta) * sqrt(1 - z * z) * r * 0.93::DOUBLE, 6) AS y, round(z * r * 0.64::DOUBLE, 6) AS z FROM u""")
def schematic_position(spark, sf_dir):
    """A place in a shell for each id: hash, four congruential steps, spherical coordinates."""
    h = [hashing.fnv1a(F.col("p_partkey").cast("string"))]
    for _ in range(4):
        h.append(hashing.lcg(h[-1]))
    u = [x / 4294967296.0 for x in h[1:]]
    side, theta, z, r = F.when(u[0] > 0.5, 1).otherwise(-1), u[1] * F.pi() * 2, u[2] * 2 - 1, F.cbrt(u[3])
    radial = F.sqrt(1 - z * z) * r
    return table(spark, sf_dir, "part").select("p_partkey", F.round(side * 0.95 + F.cos(theta) * radial * 1.32, 6).alias("x"), F.round(0.15 + F.sin(theta) * radial * 0.93, 6).alias("y"), F.round(z * r * 0.64, 6).alias("z"))


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS n, string_split(w, '') AS c FROM w GROUP BY ALL),
t AS (SELECT doc_id, w AS t, 1.0::DOUBLE AS weight, n FROM n UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: '#' || c[i] || c[i + 1] || c[i + 2])) AS t, {text.TRIGRAM_WEIGHT}::DOUBLE, n FROM n WHERE length(w) > 3),
g AS (SELECT doc_id, t, weight, sum(n) AS n FROM t GROUP BY ALL), k AS (SELECT t, {fnv_sql('t')} AS h FROM (SELECT DISTINCT t FROM g)),
s AS (SELECT doc_id, (h % {text.WORD_DIM})::INTEGER AS slot, sum(CASE WHEN (h >> 8) & 1 = 1 THEN weight * n ELSE -weight * n END) AS value FROM g JOIN k USING (t) GROUP BY ALL), q AS (SELECT doc_id, sqrt(sum(value * value)) AS norm FROM s GROUP BY doc_id)
SELECT doc_id, slot, round(value / norm, 6) + 0.0 AS value FROM s JOIN q USING (doc_id)""")
def word_trigram_encode(spark, sf_dir):
    return text.word_trigrams(table(spark, sf_dir, "documents")).select("doc_id", "slot", (F.round("value", 6) + 0.0).alias("value"))


_MODES = "['" + "', '".join(text.NOISE) + "']"


@query(rf"""WITH m AS (SELECT doc_id, text, {_MODES}[(doc_id % 8)::INTEGER + 1] AS mode FROM documents)
SELECT doc_id, mode, sha256(CASE mode WHEN 'upper' THEN upper(replace(text, 'ß', 'SS')) WHEN 'lower' THEN lower(text) WHEN 'double' THEN replace(text, ' ', '  ') WHEN 'punct' THEN regexp_replace(text, '([.,])', ' \1 ', 'g') WHEN 'tab' THEN replace(text, ' ', chr(9)) WHEN 'nbsp' THEN replace(text, ' ', chr(160))
WHEN 'zwsp' THEN regexp_replace(text, '([0-9A-Za-z_])([0-9A-Za-z_])', '\1' || chr(8203) || '\2', 'g') ELSE text END) AS noisy_sha256 FROM m""")
def format_noise(spark, sf_dir):
    """Format noise in all eight modes by the id's remainder, of every document. (The SQL spells the sharp s, whose upper case engines differ on.)"""
    mode = F.element_at(F.array(*map(F.lit, text.NOISE)), F.pmod("doc_id", F.lit(8)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", mode.alias("mode"), F.sha2(text.noise(F.col("text"), mode).cast("binary"), 256).alias("noisy_sha256"))


_SAY = "p_partkey::VARCHAR"
for _d, _n in enumerate(text.SPOKEN):
    _SAY = f"replace({_SAY}, '{_d}', ' {_n}')"


@query(f"SELECT p_partkey, trim({_SAY}) AS said FROM part")
def spoken_digits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.spoken_digits(F.col("p_partkey").cast("string")).alias("said"))


@query("""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS digest FROM part""")
def canonical_json_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.canonical_digest("p_size", "p_partkey", "p_brand").alias("digest"))


@query("SELECT doc_id, sha256(text) AS sha256, base64(unhex(md5(text))) AS md5_base64, strlen(text) AS bytes FROM documents")
def content_digest(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(raw, 256).alias("sha256"), F.base64(F.unhex(F.md5(raw))).alias("md5_base64"), F.octet_length("text").cast("long").alias("bytes"))
