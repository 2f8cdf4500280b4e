"""The registered query of each operator, over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightspark.llm import centroids, chat, decontamination, fingerprints, line_dedup, lm_scoring, mixing, near_dedup, pii, sentencepiece_codec, token_store, toxicity, whitening
from freightspark.llm.common import remainder, table

#: The conversation that every result holds besides the table's own (fixed values).
CONTROL_ID, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: ids as a digest, parity with the sentencepiece library, exact way back."""
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity, learned outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "hits")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability under the context-tree model and under the unigram base."""
    found = lm_scoring.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies."""
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("node").alias("doc_id"), "class_id", "n_verified")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written in the store's format and read back."""
    segments = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), vocabulary=49_408)
    return token_store.read_digests(segments)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base spans as counts and a digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its repeated chunks, and the code-point spans that went."""
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), spans=True)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and of its edited text, and how near those and the next text are."""
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that overlap, one row each."""
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "doc_start", "item_start", "n_matches")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control one, formatted; every figure is read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = [F.struct(F.lit(CONTROL_ID).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for k, role in enumerate(("user", "assistant"))]
    rows = rows.union(spark.range(1, numPartitions=1).select(F.inline(F.array(*control))))
    read = chat.read_chats(chat.format_chats(rows))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, lag(role, 1, 'start') OVER w AS before, row_number() OVER w AS nr,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS erole,
    replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS etext
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(5 + length(erole) + length(etext) + 8) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS valid
FROM e GROUP BY conv_id
"""


#: Any window of 13 aligned tokens with 10 equal ones has three equal ones in a row, and so has one of 8 with 7: pairs are
#: found by those, without masks.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS own FROM documents
), b AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS words FROM benchmark
), i AS (
  SELECT DISTINCT item_id, words, least(13, len(words)) AS wide FROM b WHERE len(words) >= 8
), dp AS (
  SELECT doc_id, k, own[k] || ' ' || own[k + 1] || ' ' || own[k + 2] AS gram FROM (SELECT doc_id, own, unnest(range(1, len(own) - 1)) AS k FROM d)
), ip AS (
  SELECT item_id, words, wide, k, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS gram
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS k FROM i)
), hits AS (
  SELECT DISTINCT doc_id, item_id, words, wide, dp.k - ip.k AS shift FROM dp JOIN ip USING (gram)
), aligned AS (
  SELECT doc_id, item_id, wide, greatest(shift, 0) AS doc_start, greatest(-shift, 0) AS item_start,
    [CASE WHEN own[greatest(shift, 0) + x] = words[greatest(-shift, 0) + x] THEN 1 ELSE 0 END
     FOR x IN range(1, 1 + least(len(own) - greatest(shift, 0), len(words) - greatest(-shift, 0)))] AS same
  FROM hits JOIN d USING (doc_id)
), best AS (
  SELECT doc_id, item_id, wide, doc_start, item_start, list_max([list_sum(same[x:x + wide - 1]) FOR x IN range(1, len(same) - wide + 2)]) AS n_matches
  FROM aligned WHERE len(same) >= wide
)
SELECT doc_id, item_id, CAST(doc_start AS INT) AS doc_start, CAST(item_start AS INT) AS item_start, CAST(n_matches AS INT) AS n_matches
FROM best WHERE n_matches * 13 >= wide * 10
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matches DESC, doc_start, item_start) = 1
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 components with its cluster, after three rounds of exact integer k-means."""
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes; documents of more letters come sooner."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.letter_share())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """Rounds spelled out: assign, then move the centroids."""
    assign = """a{k} AS (
  SELECT nr, any_value(vec_id) AS vec_id, any_value(v.x) AS x,
    min(struct_pack(d := list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)]), k := k)) AS best
  FROM v, c{k} c GROUP BY nr
)"""
    move = """c{after} AS (
  SELECT k, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT k, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS x
    FROM (SELECT best.k AS k, i, sum(CAST(x[i] AS DOUBLE)) AS total, count(*) AS n FROM a{k}, range(1, 65) r(i) GROUP BY ALL) GROUP BY k
  ) m USING (k)
)"""
    parts = [assign.format(k=k) + (",\n" + move.format(k=k, after=k + 1) if k < centroids.ROUNDS else "") for k in range(centroids.ROUNDS + 1)]
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS nr, vec_id, [CAST(floor({centroids.SCALE} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x FROM v QUALIFY k < {centroids.CENTROIDS}
), {", ".join(parts)}
SELECT vec_id, CAST(best.k AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN c{centroids.ROUNDS} c ON c.k = best.k
"""


#: Levels are tried from the least ratio of limit to weight on: the first that caps exactly the sources before it holds.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest,
    coalesce(0.05::DOUBLE + length(regexp_replace(text, '\P{L}+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.05::DOUBLE) AS q
  FROM documents
), keyed AS (
  SELECT *, -ln((CAST('0x' || substr(digest, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / q AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source
), tried AS (
  SELECT (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE / sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, weight, source_size
  FROM s WHERE source_size > 0 WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size, least(weight * coalesce((SELECT arg_min(level, 3 * t.source_size / t.weight) FROM tried t WHERE t.level * t.weight <= 3 * t.source_size), 0), (3 * source_size)::DOUBLE) AS target FROM s
), rests AS (
  SELECT *, coalesce(least(floor(target / nullif(source_size, 0) + 0.000001::DOUBLE), 3), 0) AS epochs FROM plan
), ordered AS (
  SELECT k.doc_id, k.source, k.size, source_size, target, epochs, greatest(target - epochs * source_size, 0) AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, digest ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, source, size, source_size, target, CAST(size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM ordered
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sentencepiece, op2_toxicity, op3_lm_scoring, op4_near_dedup, op5_token_store, op6_pii, op7_line_dedup, op8_fingerprints, op9_decontamination, op10_chat, op11_centroids, op12_mixing, op13_whitening)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": OP9_SQL, "op10_chat": OP10_SQL, "op11_centroids": _op11_sql(), "op12_mixing": OP12_SQL}
