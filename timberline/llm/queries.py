"""The registered queries over these operators, and SQL for those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, hilbert, licences, manifest, media, minhash, packing, quality, substring, suffixes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a picture in a tar shard, read back."""
    found = media.stored(_table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select(*first, F.lower(F.hex("digest")).alias("digest"), "shard", "offset", "length", "width", "height", "bits")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one that consists of control strings.

    The fingerprint of the table's schema finds the mapping for rows by turn; the added conversation is a
    record with a list of messages, and its own fingerprint finds the mapping for that."""
    rows = chat.turns_by_row(_table(spark, sf_dir, "conversations"))
    text = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": role, "content": text} for role in ("user", "assistant")]})
    added = chat.canonical(spark.createDataFrame([(-1, record)], "conv_id bigint, record string")).drop("fingerprint", "left_out")
    return chat.digests(chat.formatted(rows.unionByName(added)))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are left of every document when its repeated 35-word windows go."""
    return substring.mark(_table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 16 shards of equal counts along a Hilbert curve."""
    found = hilbert.shards(_table(spark, sf_dir, "documents"), count=16)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "curve")


def op5_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near duplicates of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document, its paragraphs or its lines are under."""
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licence", F.round("dice", 6).alias("dice"), "n_lines", "licences")


def op8_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path, end_id=2, capacity=4096)


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, posterior and verdict for every document."""
    found = quality.score(_table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, F.round("posterior", 6).alias("posterior"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labelled ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    score = F.col("toxic_score")
    return found.select("doc_id", (~toxicity.may_learn()).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op11_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are left of every document when its repeated 200-byte strings go."""
    found = suffixes.mark(_table(spark, sf_dir, "documents"), window=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and what its tampered text folds to, in a Merkle tree by language."""
    return manifest.manifest(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of 40 centroids of every vector, after five rounds."""
    return centroids.clustered(_table(spark, sf_dir, "embeddings"), size=64, k=40, rounds=5)


_QUERIES = (op1_media, op2_chat, op3_repeated_passages, op4_hilbert, op5_merge_replay, op6_minhash, op7_licences, op8_bin_slack, op9_quality_votes, op10_toxicity, op11_suffix_arrays, op12_manifest, op13_centroids)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def _licence_sql() -> str:
    quoted = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licences.TEMPLATES))
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(u, '{capitals}', '{small}'), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates AS (SELECT id, name, {grams} AS t FROM (SELECT id, name, {words} AS w FROM (VALUES {quoted}) v(id, name, u)) a),
units AS (
  SELECT doc_id, 0 AS level, i, l[i] AS u FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) a) b
  UNION ALL SELECT doc_id, 1, 0, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) FROM documents
  UNION ALL SELECT doc_id, 2, 0, coalesce(text, '') FROM documents),
sets AS (SELECT doc_id, level, i, u, {grams} AS g FROM (SELECT doc_id, level, i, u, {words} AS w FROM units) a WHERE len(w) > 1),
matches AS (
  SELECT doc_id, level, i, u, name, len(list_intersect(g, t)) AS shared, 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice
  FROM sets JOIN templates ON 2.0::DOUBLE * least(len(g), len(t)) >= {licences.THRESHOLD}::DOUBLE * (len(g) + len(t))
  WHERE 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) >= {licences.THRESHOLD}::DOUBLE),
named AS (SELECT doc_id, level, i, arg_min(name, (-shared, -dice, name)) AS name, max(shared) AS shared, arg_min(dice, (-shared, -dice, name)) AS dice FROM matches GROUP BY doc_id, level, u, i),
counted AS (SELECT doc_id, count(DISTINCT i) FILTER (level = 0) AS n_lines, bool_and(name = 'Proprietary') AS bare FROM matches GROUP BY doc_id),
best AS (
  SELECT doc_id, arg_min(name, (-dice, -shared, name)) AS licence, max(dice) AS dice, any_value(n_lines) AS n_lines,
    string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM named JOIN counted USING (doc_id) WHERE name <> 'Proprietary' OR bare GROUP BY doc_id)
SELECT d.doc_id, licence, round(coalesce(dice, 0), 6)::DOUBLE AS dice, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(licences, '') AS licences
FROM documents d LEFT JOIN best USING (doc_id)"""


_WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"


def _chat_sql() -> str:
    added = "SELECT -1 AS conv_id, i AS turn, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END AS role, '</s>[INST] ok [/INST]' AS text FROM range(2) r(i)"

    def escaped(t: str) -> str:
        marks = [chr(92), *chat.CONTROLS]
        return f"length({t})" + "".join(f" + (length({t}) - length(replace({t}, '{c}', ''))) // {len(c)}" for c in marks)

    frame = len("<|im_start|>") + 1 + len("<|im_end|>") + 1
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {added}) a)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({frame} + {escaped("role")} + (length(role) - length(replace(role, chr(10), ''))) + {escaped("text")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


def _passages_sql(window: int = 35) -> str:
    return f"""
WITH words AS (SELECT doc_id, {_WORDS.replace("{t}", "text")} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS k FROM words, unnest(range(1, len(w) - {window - 2})) r(i)),
many AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS places FROM windows JOIN many USING (k), range({window}) r(j) GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n, CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END AS left_ FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(left_))::BIGINT AS n_removed, sha256(array_to_string(left_, ' ')) AS kept_sha256 FROM kept"""


def _near_sql(percent: int = 80) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.replace("{t}", lower)} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_ AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, least(s.doc_id, coalesce(m, s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN least_ USING (doc_id)"""


def _bytes_sql(window: int = 200, step: int = 1024) -> str:
    """Texts as hex, two digits a byte; windows are cut from overlapping parts of ``step`` bytes."""
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT r, k * {step} AS base, substring(x, 2 * k * {step} + 1, 2 * {step + window - 1}) AS p FROM texts, unnest(range((len(x) // 2 - {window - step}) // {step})) u(k) WHERE len(x) >= {2 * window}),
windows AS (SELECT r, base + j AS i, md5_number(substring(p, 2 * j + 1, {2 * window})) AS h FROM parts, unnest(range(len(p) // 2 - {window - 1})) u(j)),
many AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM windows SEMI JOIN many USING (h)),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {window} THEN 0 ELSE 1 END AS new FROM hit) a),
spans AS (SELECT r, min(i) AS s, max(i) + {window} AS e FROM runs GROUP BY r, g),
ordered AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM spans),
kept AS (SELECT r, count(*) AS n, sum(e - s) AS gone, max(e) AS last, string_agg(substring(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS k FROM ordered JOIN texts USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k || substring(x, 2 * last + 1), x))) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)"""


def _manifest_sql(depth: int = 11) -> str:
    """The levels are written out, ``depth`` of them: 8 ** 11 leaves a language."""

    def field(value: str, size: str) -> str:
        return f"coalesce({size} || ':' || {value}, '-')"

    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join([field(f"{c}::VARCHAR", f"strlen({c}::VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")])
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {bit})), 4294967295)"
    ctes = [
        f"leaves AS (SELECT doc_id, lang, sha256({head} || {field('text', 'strlen(text)')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(small, f'strlen({small})')}) END AS changed FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM leaves)",
        "t0 AS (SELECT coalesce('=' || lang, '') AS g, pos, leaf AS h FROM placed)",
        "f0 AS (SELECT coalesce('=' || lang, '') AS g, doc_id, pos AS own, pos, leaf, coalesce(changed, leaf) AS f, '' AS proof FROM placed)",
    ]

    def grown(t: str, f: str, k: int) -> list[str]:
        runs = f"(SELECT g, pos // 8 AS run, list(h ORDER BY pos) AS l, any_value(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {t}{k - 1}) a GROUP BY g, pos // 8)"
        others = "list_filter(l, lambda x, i: i <> pos % 8 + 1)"
        put = "list_transform(l, lambda x, i: CASE WHEN i = pos % 8 + 1 THEN f ELSE x END)"
        return [
            f"r{t}{k} AS MATERIALIZED {runs}",
            f"{t}{k} AS MATERIALIZED (SELECT g, run AS pos, CASE WHEN m = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS h FROM r{t}{k})",
            f"{f}{k} AS MATERIALIZED (SELECT r.g, doc_id, own, run AS pos, leaf, CASE WHEN m = 1 THEN f ELSE sha256(array_to_string({put}, '')) END AS f, CASE WHEN m = 1 THEN proof ELSE proof || array_to_string({others}, '') END AS proof"
            f"{', subroot' if f == 'q' else ''} FROM {f}{k - 1} d JOIN r{t}{k} r ON d.g = r.g AND d.pos // 8 = r.run)",
        ]

    for k in range(1, depth + 1):
        ctes += grown("t", "f", k)
    ctes += [
        f"langs AS (SELECT g AS lang, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM t{depth})",
        "u0 AS (SELECT '' AS g, pos, h FROM langs)",
        f"q0 AS (SELECT '' AS g, doc_id, own, l.pos, leaf, f, proof, h AS subroot FROM f{depth} d JOIN langs l ON d.g = l.lang)",
    ]
    for k in range(1, depth + 1):
        ctes += grown("u", "q", k)
    return f"""
WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{depth} JOIN u{depth} USING (g)"""


def _centroids_sql(size: int = 64, k: int = 40, rounds: int = 5) -> str:
    """Rounds are written out; a centroid's components are joined again in their order."""
    good = f"len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}"
    ctes = [
        f"vectors AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {good})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS w FROM vectors ORDER BY sha256('2:' || vec_id), v LIMIT {k})",
    ]
    apart = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v[i] - w[i]) * (v[i] - w[i])))"
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (SELECT r, c, {apart} AS d FROM vectors, c{n}) x GROUP BY r)")
        if n < rounds:
            ctes.append(
                f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(x, w) AS w FROM c{n} LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM (SELECT best.c AS c, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m "
                f"FROM a{n} JOIN vectors USING (r), unnest(range(1, {size + 1})) u(i) GROUP BY best.c, i) y GROUP BY c) z USING (c))"
            )
    return f"""
WITH {", ".join(ctes)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM vectors JOIN a{rounds} USING (r) JOIN c{rounds} f ON f.c = best.c"""


def oracle_sql() -> dict[str, str]:
    """Of the others, SQL has no library's ids, compressed pictures, weights or fillings; they are tested by brute force."""
    return {
        "op2_chat": _chat_sql(),
        "op3_repeated_passages": _passages_sql(),
        "op6_minhash": _near_sql(),
        "op7_licences": _licence_sql(),
        "op11_suffix_arrays": _bytes_sql(),
        "op12_manifest": _manifest_sql(),
        "op13_centroids": _centroids_sql(),
    }
