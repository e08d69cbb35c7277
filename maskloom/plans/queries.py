"""The queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DETECTION, matches, merge_array, substituted, token_spans as tokens_of
from ..functions.patterns import DETECTORS
from ..operators import chunk, dataset, detect, mask, metrics, spans, unmask
from ..sources.files import table
from . import oracles
from .views import prompts, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _scan(entity: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")) if entity == "URL" else prompts(spark, sf_dir)
        return detect.scan_text(docs, [entity])

    return run


def _generate(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sample = oracles.SAMPLES[kind]
        if kind in ("MONEY", "DATE", "NAME"):
            name = "customer" if kind == "NAME" else "orders"
            own = spark.sql(sample.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})
        else:
            pattern = DETECTORS[{"PHONE": "INDIAN_PHONE", "IP": "IPV4", "GENERIC": "IBAN"}.get(kind, kind)][0]
            own = prompts(spark, sf_dir).select(F.explode(matches(F.col("text"), pattern)).alias("m")).select(F.col("m.value").alias("original")).distinct()
        return own.select("original", substituted(F.lit(kind), F.col("original"), F.lit("7")).alias("substitute"))

    return run


QUERIES |= {f"scan_{e.lower()}": _scan(e) for e in DETECTORS}
QUERIES |= {f"generate_{k.lower()}": _generate(k) for k in oracles.SAMPLES}


@query
def scan_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan_text(texts(spark, sf_dir), ["INDIAN_PHONE", "CREDIT_CARD", "EMAIL", "IPV4"])


@query
def scan_valid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan_valid_text(prompts(spark, sf_dir))


@query
def scan_text_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan_text(texts(spark, sf_dir))


@query
def variant_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.variant_rows(prompts(spark, sf_dir)).groupBy("doc_id", "detector", "value").agg(F.count("*").alias("n"))


@query
def variant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = prompts(spark, sf_dir).selectExpr("doc_id", "text", "CASE doc_id % 3 WHEN 0 THEN 'PAN' WHEN 1 THEN 'PHONE' ELSE 'INVALID' END AS expect")
    return detect.variant_report(cases).select("doc_id", "expect", "found", "passed")


@query
def ignore_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tags(spark, sf_dir).select("doc_id", dataset.without_ignored(F.array("a", "b", "c"), F.array(F.lit(-100), F.col("c"), F.col("a"))).alias("x"))
    return rows.select("doc_id", _joined(F.col("x.pred")).alias("pred"), _joined(F.col("x.lab")).alias("lab"))


@query
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.first_rows(_tags(spark, sf_dir), "doc_id")


@query
def wiped_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.without_session(mask.vault(mask.mask_pipeline(prompts(spark, sf_dir))).drop("seq"), 3)


@query
def detected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("doc_id", F.array_join(detect.detected_types(F.col("text")), ",").alias("types"))


@query
def mock_ner_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(texts(spark, sf_dir), detect.mock_person(F.col("text")))


@query
def mock_ner_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(prompts(spark, sf_dir), detect.mock_org(F.col("text")))


@query
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(prompts(spark, sf_dir), detect.rule_spans(F.col("text"), oracles.RULES))


@query
def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(prompts(spark, sf_dir), detect.rule_spans(F.col("text"), detect.keyword_rules(oracles.WORDS)))


@query
def keyword_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(prompts(spark, sf_dir), detect.dictionary_spans(F.col("text")))


@query
def keyword_dictionary_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(prompts(spark, sf_dir), detect.dictionary_spans(F.col("text"), oracles.TERMS))


@query
def external_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(prompts(spark, sf_dir), detect.entity_spans(F.col("text"), F.expr(oracles.ENTITIES)))


def _span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return detect.exploded(prompts(spark, sf_dir), F.concat(detect.regex_spans(text), detect.recognized(text)))


@query
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_spans(_span_rows(spark, sf_dir)).drop("confidence")


@query
def merge_spans_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    own = prompts(spark, sf_dir).withColumn("own", F.concat(detect.regex_spans(text), detect.recognized(text)))
    return detect.exploded(own, merge_array(F.col("own"))).drop("confidence")


VALID = f"array<{DETECTION[:-1]}, ord: int>>"


def _valid_array() -> F.Column:
    good = F.filter(detect.detections(F.col("text")), lambda d: d["is_valid"])
    return F.transform(good, lambda d, i: F.struct(d["entity_type"].alias("entity_type"), d["start"].alias("start"), d["end"].alias("end"), d["value"].alias("value"), d["is_valid"].alias("is_valid"), i.alias("ord")))


@query
def drop_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prompts(spark, sf_dir).withColumn("own", _valid_array())
    return detect.exploded(own, spans.drop_contained_array(F.col("own"), VALID)).drop("is_valid", "ord")


@query
def greedy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prompts(spark, sf_dir).withColumn("own", _valid_array())
    return detect.exploded(own, spans.greedy_array(F.col("own"), F.octet_length("text"), VALID)).drop("is_valid", "ord")


@query
def mask_text_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prompts(spark, sf_dir).withColumn("own", _valid_array())
    return mask.mask_text_greedy(own, F.col("own")).select("doc_id", "masked")


@query
def mask_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_summary(prompts(spark, sf_dir))


@query
def mask_summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_summary(texts(spark, sf_dir))


@query
def mask_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_pipeline(prompts(spark, sf_dir)).select("doc_id", "session_id", "masked")


@query
def mask_without_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_pipeline(prompts(spark, sf_dir), mock=False).select("doc_id", "session_id", "masked")


@query
def mask_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    rules = mask.rules_from_json(json.dumps([{"pattern": p, "replacement_type": k} for p, k in oracles.RULES]))
    return mask.mask_pipeline(prompts(spark, sf_dir), rules=rules).select("doc_id", "session_id", "masked")


@query
def mask_with_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    return mask.mask_pipeline(prompts(spark, sf_dir), keywords=mask.keywords_from_json(json.dumps(oracles.WORDS))).select("doc_id", "session_id", "masked")


@query
def mask_with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_pipeline(prompts(spark, sf_dir), entities=F.expr(oracles.ENTITIES)).select("doc_id", "session_id", "masked")


@query
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).withColumn("session_id", F.col("doc_id") % 100)
    return mask.mask_pipeline(docs).select("doc_id", "masked", F.size("spans").alias("n_spans"))


@query
def vault_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.vault(mask.mask_pipeline(prompts(spark, sf_dir))).drop("seq")


@query
def vault_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.reverse_vault(mask.vault(mask.mask_pipeline(prompts(spark, sf_dir))))


def _replies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    masked = mask.mask_pipeline(prompts(spark, sf_dir), mock=False).select("doc_id", "session_id", "spans", "masked")
    typed = F.concat(F.substring("masked", 1, 11), F.lit("0"), F.expr("substr(masked, 13)"))
    return masked.select(F.col("doc_id").alias("reply_id"), "session_id", typed.alias("text")), mask.reverse_vault(mask.vault(masked))


@query
def unmask_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmask.unmask_exact(*_replies(spark, sf_dir)).select("reply_id", "session_id", "exact")


@query
def unmask_fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies, reverse = _replies(spark, sf_dir)
    return unmask.fuzzy_tokens(replies, reverse).groupBy("reply_id", "masked", "revealed").agg(F.count("*").alias("n"))


@query
def unmask_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmask.unmask_fuzzy(*_replies(spark, sf_dir)).select("reply_id", "text", F.array_join(F.transform("fuzzy_spans", lambda s: F.concat_ws("|", s["utf16_start"], s["utf16_end"], s["masked"], s["revealed"])), ",").alias("spans"))


@query
def unmask_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmask.unmask_json(*_replies(spark, sf_dir))


@query
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.redact_pii(texts(spark, sf_dir))


@query
def redact_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.redact_pii(prompts(spark, sf_dir))


@query
def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.profiled(mask.mask_pipeline(prompts(spark, sf_dir)))


@query
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.explode(tokens_of(F.col("text"))).alias("t")).select("doc_id", "t.*")


@query
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(texts(spark, sf_dir))


@query
def chunk_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(texts(spark, sf_dir), 100, 25)


@query
def tier4_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.tier4_detect(texts(spark, sf_dir))


@query
def tier4_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of tokens that some documents pass: an error each."""
    return chunk.tier4_detect(texts(spark, sf_dir), most=600)


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(oracles.TAG_ROWS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


@query
def clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tags(spark, sf_dir).selectExpr("doc_id", "array(concat('w', a), CAST(b AS STRING)) AS tokens", "CASE c WHEN 0 THEN array(CAST(a AS STRING)) WHEN 1 THEN array('x', '1') ELSE array(CAST(c AS STRING), CAST(a AS STRING)) END AS ner_tags")
    kept = dataset.clean(rows.select(F.array(F.col("doc_id").cast("string"), F.col("tokens")[0], F.col("tokens")[1]).alias("tokens"), F.concat(F.array(F.col("doc_id").cast("string")), "ner_tags").alias("ner_tags")))
    return kept.select(F.col("ner_tags")[0].cast("bigint").alias("doc_id"), F.concat_ws(" ", F.slice("tokens", 2, 2)).alias("tokens"), F.concat_ws(" ", F.slice("ner_tags", 2, 2).cast("array<string>")).alias("ner_tags"))


def _joined(c: F.Column) -> F.Column:
    return F.concat_ws(" ", c.cast("array<string>"))


@query
def normalize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("doc_id", _joined(dataset.without_misc(F.array("a", "b", "c"))).alias("tags"))


@query
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = dataset.label_names(F.array("a", "b"))
    return _tags(spark, sf_dir).select("doc_id", named.alias("names")).select("doc_id", _joined(dataset.label_ids(F.col("names"))).alias("ids"))


@query
def concat_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tags(spark, sf_dir)
    return dataset.concat(rows.select("doc_id", "a"), rows.select("doc_id", F.col("b").alias("a")))


def _word_ids() -> F.Column:
    return F.array(*(F.lit(x).cast("int") for x in (None, 0, 0, 1, 2, 2, 9, None)))


@query
def align_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("doc_id", _joined(dataset.align_first(_word_ids(), F.array("a", "b", "c"))).alias("labels"))


@query
def align_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("doc_id", _joined(dataset.align_all(_word_ids(), F.array("a", "b", "c"))).alias("labels"))


@query
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array("a", "b", "c")
    return _tags(spark, sf_dir).select("doc_id", _joined(dataset.fixed_length(own, 0, 5)).alias("padded"), _joined(dataset.fixed_length(own, 0, 2)).alias("cut"))


@query
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", metrics.argmax(F.col("embedding")).alias("argmax"))


@query
def prediction_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("doc_id", metrics.similarity(F.array("a", "b", "c"), F.array("b", "c", "c")).alias("similarity"))


@query
def seqeval_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tags(spark, sf_dir).select(dataset.label_names(F.array("a", "b", "c")).alias("pred"), dataset.label_names(F.array("a", "b", F.col("c") % 5)).alias("true"))
    return metrics.scores(rows)


@query
def synthetic_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.synthetic_ner(spark).select("id", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("ner_tags"))


@query
def synthetic_money_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.synthetic_money_date(spark).select("id", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("ner_tags"))
