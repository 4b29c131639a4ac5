"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import chat, decontaminate, jaccard, language, lines, mixing, order_minhash, packing, quality, repair, sharding, substrings, whitening
from sluice.llm.shared import table

SHARD_BYTES = 16 << 20
LINE_BATCHES = 4
GOOD = 0.3

#: What the calls that op10 derives from conversations may hold.
TOOLS = {
    "search": {
        "properties": {"query": {"type": "string", "minLength": 8}, "limit": {"type": "integer", "minimum": 1, "maximum": 150}},
        "required": ["query", "limit"],
    },
    "lookup": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer", "maximum": 200}}, "required": ["query"]},
    "count": {"properties": {"limit": {"type": "integer"}}, "required": ["limit"], "additionalProperties": True},
}


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items: one row per document and item."""
    return decontaminate.Decontaminator().matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, targets, _ = mixing.SourceMix().plan(table(spark, sf_dir, "documents"), F.array("source"), ["doc_id"])
    own = F.col("_pattern")[0]
    return rows.join(targets, own.eqNullSafe(F.col("s"))).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "copies"
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = lines.dedup_lines(docs, lines.file_batches(docs.select("text"), LINE_BATCHES))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "n_bytes", "shard")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.OrderMinHash().against_edits(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.SubstringDedup().apply(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = language.LanguageTrainer().fit(language.train_rows(docs, F.col("held_out"), "lang", "text"))
    return language.identify(docs, model, ["doc_id", "held_out"])


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.AdditiveModel:
    labels = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", F.col("quality").alias("_label"))
    rows = quality.measured(docs.filter(~held_out()), ["doc_id"]).join(labels, "doc_id")
    return quality.AdditiveTrainer().fit_measured(rows)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    scored = quality.score(docs, quality_model(spark, sf_dir, docs), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def conversation_events(turns: DataFrame) -> DataFrame:
    """Conversations as events: assistant turns are calls, the turn after a turn is its result.

    The tool and its arguments follow from the text, and every call follows the call before it.
    The arguments hold the whole text; what is too long or short is for the schema to say.
    """
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")

    def call_at(shift: int) -> Column:
        return F.concat(F.lit("c"), conv, F.lit("-"), (turn - shift).cast("string"))

    kind = F.when(F.col("role") == "assistant", "call").when((F.col("role") == "user") & (turn > 0), "result").otherwise("message")
    names = F.array(*(F.lit(n) for n in (*TOOLS, "browse")))
    text = F.coalesce("text", F.lit(""))
    arguments = F.to_json(F.struct(text.alias("query"), mixing.word_count(text).alias("limit")))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv"), turn.cast("long").alias("place"), kind.alias("kind"), "role",
        F.when(kind == "call", call_at(0)).when(kind == "result", call_at(1)).alias("call_id"),
        F.when(kind == "call", call_at(2)).alias("follows"),
        F.when(kind == "call", F.get(names, F.pmod(F.crc32(text.cast("binary")), F.lit(len(TOOLS) + 1)).cast("int"))).alias("name"),
        F.when(kind == "call", arguments).otherwise(F.col("text")).alias("payload"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link_calls(conversation_events(table(spark, sf_dir, "conversations")), TOOLS)
    return linked.withColumnsRenamed({"conv": "conv_id", "place": "turn"})


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.Whitening().apply(table(spark, sf_dir, "embeddings"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of conversation and turn; nulls become one space."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    report, repaired = repair.ConversationRepair().apply(damaged(turns))
    told = repair.joined(report, repair.digests(repaired), ["conv"], "left")
    every = turns.select(F.col("conv_id").alias("conv")).distinct()
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return repair.joined(every, told, ["conv"], "left").select(
        F.col("conv").alias("conv_id"), *(value.alias(name) for name, value in zero.items()), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.SequencePacker(tokenizer_path()).pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_ngram_jaccard, op3_source_mix, op4_line_dedup, op5_sharding, op6_order_minhash,
        op7_substring_dedup, op8_language_id, op9_quality, op10_chat_format, op11_whitening, op12_structure_repair, op13_packing,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = lines.UPPER, lines.LOWER
_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}')"

ORACLES: dict[str, str] = {
    "op4_line_dedup": f"""
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        flat AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
        keyed AS (SELECT doc_id, pos, line, {_KEY} AS k FROM flat),
        frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id""",
    "op5_sharding": f"""
        WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
            right(repeat('0', 60) || bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT), 60) AS bits
            FROM documents),
        deep AS (SELECT d.*, unnest(range(0, 61)) AS depth FROM d),
        held AS (SELECT depth, left(bits, depth) AS p, sum(n_bytes) AS b, count(*) AS n FROM deep GROUP BY ALL)
        SELECT doc_id, n_bytes, left(bits, min(deep.depth)) AS shard
        FROM deep JOIN held ON held.depth = deep.depth AND held.p = left(bits, deep.depth) AND (b <= {SHARD_BYTES} OR n = 1)
        GROUP BY doc_id, n_bytes, bits""",
    "op7_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS s, ws FROM w WHERE len(ws) >= 50),
        windows AS (SELECT doc_id, s, md5(array_to_string(ws[s:s+49], ' ')) AS h FROM starts),
        least AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS at FROM windows JOIN least USING (h) WHERE first < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w)
        SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN (
            SELECT words.doc_id, count(*) AS n_words, count(gone.at) AS n_removed,
                   string_agg(CASE WHEN gone.at IS NULL THEN word END, ' ' ORDER BY words.at) AS kept
            FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.at = words.at GROUP BY words.doc_id) x
        ON x.doc_id = d.doc_id""",
}
