"""The text operators over the whole given tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, near_dup, negatives, packing, pii, quality, repair, sharding, sketch, suffix, tokens, urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (f"cast(size(filter(base, x -> x.kind = {k})) as bigint) as n_{name}" for k, name in enumerate(pii.KINDS))
    return found.selectExpr(
        "doc_id", *counts, f"sha2({pii.named('base')}, 256) as base_sha256",
        f"{pii.named('sort_array(concat(base, added))')} as spans",
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words and more in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.selectExpr(
        "doc_id", "n_words", "n_hit", "cast(size(items) as bigint) as n_items",
        "sha2(array_join(items, ','), 256) as items_sha256", "contaminated",
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards by rendezvous hashing of their ids, and in 17."""
    sized = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "cast(coalesce(octet_length(text), 0) + 1 as bigint) as size",
        "crc32(coalesce(text, '')) as text_crc32", "'key' as law",
    )
    placed = sharding.place(sized, ["doc_id"], dict.fromkeys(range(16), 1.0))
    placed = sharding.place(placed, ["doc_id"], dict.fromkeys(range(17), 1.0), "grown_shard")
    return sharding.slots(placed, ["doc_id", "text_crc32", "size"])


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url by rules, else by the templates of its host.

    A page's number in its url is the document it was made from; the page is
    bad if that document is labelled toxic or of low quality.
    """
    parts = urls.with_parts(table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    made_from = parts.selectExpr(
        "page_id", "host", "path", "try_cast(regexp_extract(path, '/([0-9]+)[^0-9/]*/?$', 1) as bigint) as _doc"
    )
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg({"quality": "min", "toxic": "max"})
    bad = labels.selectExpr("doc_id as _doc", "if(`min(quality)` = 0 or `max(toxic)` = 1, 1, 0) as bad")
    judged = urls.judge(made_from.join(bad, "_doc", "left").drop("_doc"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of each document and of its text with the end taken from the next one."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') as text")
    cut = "cast(floor(length(text) / 4) as int)"
    pairs = sketch.followed(docs, "doc_id", "text", "next").selectExpr(
        "doc_id", "cast(length(text) as bigint) as n_chars", "text", "next",
        f"concat(substr(text, 1, length(text) - {cut}), substr(next, 1, {cut})) as edited",
    )
    for name in ("text", "edited", "next"):
        pairs = sketch.with_sketch(pairs, name, f"_{name}")
    return pairs.selectExpr(
        "doc_id", "n_chars", "sha2(edited, 256) as edited_sha256",
        f"{sketch.shown('_text')} as fingerprint", f"{sketch.shown('_edited')} as edited_fingerprint",
        f"{sketch.resemblance('_text', '_edited')} as near_edited", f"{sketch.resemblance('_text', '_next')} as near_next",
        f"{sketch.distinct('_text')} as n_shingles", f"{sketch.containment('_edited', '_text')} as edited_in_text",
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through layouts, canonical turns and one training text, read back from it.

    A conversation arrives as one JSON record: prompt and completion if it is
    one question and its answer, instruction, input and output if it is a
    system turn before these and the input is not empty, else a list of messages.
    """
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as content"
    )
    extra = r"inline(array(struct(0L, 'user', r'\### Assistant: </turn> ok'), struct(1L, 'assistant', r'\### Assistant: </turn> ok')))"
    turns = turns.unionByName(spark.range(1).selectExpr("-7L as conv_id", extra).toDF("conv_id", "turn", "role", "content"))
    whole = (
        turns.groupBy("conv_id")
        .agg(F.expr("sort_array(collect_list(struct(turn, role, content))) as _turns"))
        .selectExpr("conv_id", "transform(_turns, x -> struct(x.role, x.content)) as messages", "_turns.role as roles")
    )
    records = whole.selectExpr(
        "conv_id",
        "case when roles = array('user', 'assistant') then "
        "to_json(named_struct('prompt', messages[0].content, 'completion', messages[1].content)) "
        "when roles = array('system', 'user', 'assistant') and messages[1].content <> '' then to_json(named_struct('instruction', "
        "messages[0].content, 'input', messages[1].content, 'output', messages[2].content)) "
        "else to_json(named_struct('messages', messages)) end as record",
    )
    read = chat.parsed(chat.formatted(chat.canonical(records, "record")))
    return read.selectExpr(
        "conv_id", "cast(size(read_turns) as bigint) as n_turns",
        r"sha2(array_join(transform(read_turns, x -> concat(x.role, '\n', x.text, '\n')), ''), 256) as turns_sha256",
        "cast(length(loss_text) as bigint) as loss_chars", "sha2(loss_text, 256) as loss_sha256",
        "cast(length(formatted) as bigint) as formatted_chars", "layout",
    )


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 of 100 five-word shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior, score and verdicts for each document."""
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "votes", "posterior", "score", "good", "toxic")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tokens in windows of 2048."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur more than once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.without_repeats(docs, with_bytes=False).drop("kept")


# What happens to a row, by the remainder of its checksum.
DROPPED, EMPTIED, UNENDED, REPEATED, RENAMED = range(5)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, left without ends of sentences, repeated or given to the user."""
    named = "concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))"
    rows = conversations.selectExpr(
        "conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text", f"crc32({named}) % 20 as _fate"
    )
    text = f"case _fate when {EMPTIED} then '' when {UNENDED} then translate(text, '.!?', '') else text end"
    return rows.where(f"_fate <> {DROPPED}").selectExpr(
        "conv_id", "turn", f"if(_fate = {RENAMED}, 'user', role) as role", f"{text} as text",
        f"explode(sequence(1, if(_fate = {REPEATED}, 2, 1)))",
    ).drop("col")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired: faults, cost, edits and a digest of each."""
    conversations = table(spark, sf_dir, "conversations")
    found, messages = repair.repair(damaged(conversations))
    found = found.withColumnRenamed("conv_id", "_found")
    told = repair.digests(messages).withColumnRenamed("conv_id", "_told")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.expr("conv_id <=> _found"), "left").join(told, F.expr("conv_id <=> _told"), "left")
    sums = (f"coalesce({c}, 0L) as {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return joined.selectExpr(
        "conv_id", *sums, "coalesce(audit, '') as audit", "coalesce(sha256, sha2('', 256)) as repaired_sha256"
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of each document, and whether there are more than 4096."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "cast(coalesce(octet_length(text), 0) as bigint) as n_bytes")
    counted = tokens.with_tokens(docs, tokenizer_file("piece_bpe_32k.model"), limit=4096)
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives that score from 80 to 100 hundredths of each positive of the anchors; a seventh of the labels is changed first."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "embedding", "if(vec_id % 7 = 0, (label + 1) % 10, label) as label"
    )
    return negatives.hard_negatives(vectors, "vec_id % 100 = 0")


QUERIES = {
    f.__name__: f for f in (op1_pii, op2_quality, op3_decontaminate, op4_suffix_dedup, op5_sharding, op6_urls, op7_fingerprints, op8_packing, op9_chat, op10_near_dup, op11_repair, op12_token_counts, op13_hard_negatives)
}
