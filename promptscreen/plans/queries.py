"""A query for each operator, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import fusion, injection, judge, normalize, ratelimit, semantic
from ..operators.behavior import SIGNALS, behave
from ..operators.gate import audit_rows, gate
from ..sources import tables
from ..sources.shared import shared_folder
from ..streaming.screening import admit_stream, audit_stream, screen_stream
from . import views
from .analyze import analyze, screen
from .corpus import PROMPTS, SECRETS, corpus, spread

KEY = ["conv_id", "turn", "k"]


def documents(spark, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _detector(name: str):
    """Number and offsets of a detector's spans, in documents and in prompts with secrets."""

    def digest(df: DataFrame, a: Column, b: Column) -> DataFrame:
        out = df.withColumn("s", S.detector(F.col("text"), name))
        total = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda x, s: x + s[f])
        return out.select(a.cast("long").alias("a"), b.cast("long").alias("b"), F.size("s").alias("n"), total("start").alias("starts"), total("end").alias("ends"))

    def run(spark, sf_dir: str) -> DataFrame:
        docs = digest(documents(spark, sf_dir).select("doc_id", "text"), F.col("doc_id"), F.lit(-1))
        made = digest(corpus(spark, sf_dir, SECRETS), F.col("conv_id") * 1000 + F.col("turn"), F.col("k"))
        return docs.unionByName(made)

    return run


def _gated(spark, sf_dir: str, **options) -> DataFrame:
    return gate(documents(spark, sf_dir), **options)


def span_merge(spark, sf_dir: str) -> DataFrame:
    out = gate(corpus(spark, sf_dir, SECRETS))
    return out.select(*KEY, F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["dtype"], s["start"], s["end"])), ",").alias("kept"))


def span_redact(spark, sf_dir: str) -> DataFrame:
    return gate(corpus(spark, sf_dir, SECRETS)).select(*KEY, "redacted")


def gate_decision(spark, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("doc_id", "action", "reason", "n_findings", T.payload_digest(F.col("redacted")).alias("redacted_sha256"))


def gate_prompts(spark, sf_dir: str) -> DataFrame:
    return gate(corpus(spark, sf_dir, SECRETS), hard_block_keys=False, auto_redact=False).select(*KEY, "action", "reason")


def gate_policy(spark, sf_dir: str) -> DataFrame:
    """Policy by verdict, unknown verdicts too, and a policy of one's own."""
    verdicts = F.element_at(F.array(*[F.lit(v) for v in ("SAFE", "MEDIUM_RISK", "HIGH_RISK", "BLOCKED", "WHATEVER")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    docs = documents(spark, sf_dir).select("doc_id", "text", verdicts.alias("verdict"))
    own = gate(docs, verdict_col="verdict", policy={"MEDIUM_RISK": "BLOCK"}).select("doc_id", F.col("action").alias("own_action"))
    return gate(docs, verdict_col="verdict").select("doc_id", "verdict", "action", "reason").join(own, "doc_id")


def gate_by_action(spark, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("n_findings").cast("long").alias("findings"))


def gate_by_lang_source(spark, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy("lang", "source", "action").agg(F.count(F.lit(1)).alias("n"))


def findings_by_type(spark, sf_dir: str) -> DataFrame:
    found = _gated(spark, sf_dir).select(F.explode("spans").alias("s"))
    return found.groupBy(F.col("s.dtype").alias("dtype")).agg(F.count(F.lit(1)).alias("n"))


def audit_digest(spark, sf_dir: str) -> DataFrame:
    """What an audit record says, without its time."""
    return audit_rows(_gated(spark, sf_dir)).select("payload_sha256", "action", "reason", "intent_verdict", "risk_score", "llm_used")


def _normalized(spark, sf_dir: str) -> DataFrame:
    return normalize.normalize(corpus(spark, sf_dir, PROMPTS))


def obf_normalized(spark, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).select(*KEY, "normalized", F.array_join("techniques", ",").alias("techniques"), "obfuscation_detected", "obfuscation_risk")


def _technique(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return _normalized(spark, sf_dir).select(*KEY, F.array_contains("techniques", name).alias("found"))

    return run


def obf_documents(spark, sf_dir: str) -> DataFrame:
    out = normalize.normalize(documents(spark, sf_dir))
    return out.select("doc_id", T.payload_digest(F.col("normalized")).alias("normalized_sha256"), F.array_join("techniques", ",").alias("techniques"))


def _behaved(spark, sf_dir: str, patterns: bool = True) -> DataFrame:
    return behave(corpus(spark, sf_dir, PROMPTS), "text", patterns)


def beh_flags(spark, sf_dir: str) -> DataFrame:
    return _behaved(spark, sf_dir, False).select(*KEY, *[f"has_{s}" for s in (*SIGNALS, "retrieval", "target", "combination")])


def beh_first_pattern(spark, sf_dir: str) -> DataFrame:
    named = F.array_join(F.transform("behaviors", lambda b: F.concat(b["behavior"], F.lit("="), F.col("matched_patterns")[b["behavior"]])), ",")
    return _behaved(spark, sf_dir).select(*KEY, named.alias("patterns"))


def beh_score(spark, sf_dir: str) -> DataFrame:
    return _behaved(spark, sf_dir, False).select(*KEY, "behavior_risk", "behavior_branch", F.array_join(F.transform("behaviors", lambda b: b["behavior"]), ",").alias("behaviors"))


def sem_fallback(spark, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, PROMPTS).select(*KEY, semantic.keyword_risk(F.col("text")).alias("semantic_risk"))


def trf_fallback(spark, sf_dir: str) -> DataFrame:
    c = injection.keyword_confidence(F.col("text"))
    return corpus(spark, sf_dir, PROMPTS).select(*KEY, c.alias("injection_confidence"), (c > 0.5).alias("is_injection"), injection.injection_risk(c > 0.5, c).alias("injection_risk"))


def trf_score(spark, sf_dir: str) -> DataFrame:
    """The score of a classifier's label and confidence, here those of labels and embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("label") % 2 == 0).alias("hit"), F.pmod("vec_id", F.lit(100)).cast("double").alias("c"))
    return rows.select("vec_id", injection.injection_risk(F.col("hit"), F.col("c") / 100).alias("injection_risk"))


def _vectors(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def sem_centroid(spark, sf_dir: str) -> DataFrame:
    """Centroids of labels as intents, rounded."""
    c = semantic.centroids(_vectors(spark, sf_dir), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "x"))
    return c.select("label", "i", F.round("x", 6).alias("x"))


def _scored(spark, sf_dir: str, places: int = 6) -> tuple[DataFrame, dict]:
    """Similarity of each vector to the centroids of labels 0 to 4, which stand for the five intents."""
    c = semantic.centroids(_vectors(spark, sf_dir).where("label BETWEEN 0 AND 4"), "label", "embedding")
    wide = c.groupBy().pivot("label", [0, 1, 2, 3, 4]).agg(F.first("centroid"))  # one row: five vectors
    rows = _vectors(spark, sf_dir).join(F.broadcast(wide))
    rows = rows.select("vec_id", *[F.coalesce(F.round(semantic.cosine(F.col("embedding"), F.col(str(k))), places), F.lit(0.0)).alias(f"s{k}") for k in range(5)])
    names = [(d, i) for d, own in P.INTENTS.items() for i in own]
    scores: dict = {d: {} for d in P.INTENTS}
    for k, (d, i) in enumerate(names):
        scores[d][i] = F.col(f"s{k}")
    return rows, scores


def sem_cosine(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[0]


def sem_rules(spark, sf_dir: str) -> DataFrame:
    rows, scores = _scored(spark, sf_dir)
    return rows.select("vec_id", semantic.rule_risk(scores).alias("semantic_risk"), F.array_join(semantic.rules_fired(scores), ",").alias("rules"))


def sem_confidence(spark, sf_dir: str) -> DataFrame:
    rows, scores = _scored(spark, sf_dir)
    return rows.select("vec_id", F.round(semantic.score_confidence(scores), 5).alias("confidence"))


def _risks(spark, sf_dir: str) -> DataFrame:
    """Signals of all kinds, from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.floor(F.col("event_id") / by), F.lit(len(values))) + 1).cast("int"))
    return e.select("event_id", pick([0, 15], 1).alias("o"), pick([0, 65, 70, 72, 78], 2).alias("b"), pick([0, 55, 60, 90, 95], 10).alias("s"), pick([0.5, 0.6, 0.75, 0.85], 50).alias("sc"), pick([0, 60, 80], 200).alias("t"), pick([0.3, 0.55, 0.9], 600).alias("tc"))


def fuse(spark, sf_dir: str) -> DataFrame:
    rows = _risks(spark, sf_dir).withColumn("e", fusion.signals(*[F.col(c) for c in ("o", "b", "s", "sc", "t", "tc")]))
    risk, confidence = fusion.fused(F.col("e"))
    return rows.select("event_id", risk.alias("risk"), confidence.alias("confidence"))


def triage(spark, sf_dir: str) -> DataFrame:
    rows = fuse(spark, sf_dir)
    r, c = F.col("risk"), F.col("confidence")
    return rows.select("event_id", fusion.triage_reason(r, c).alias("reason"), T.verdict_of(r).alias("verdict"), fusion.confident_block(r, c).alias("blocked"))


def analyze_prompts(spark, sf_dir: str) -> DataFrame:
    return analyze(corpus(spark, sf_dir, PROMPTS, bits=True), explain=False, bits_col="bits").select(*KEY, "risk_score", "verdict", "confidence", "early_block")


def analyze_documents(spark, sf_dir: str) -> DataFrame:
    return analyze(documents(spark, sf_dir), explain=False).select("doc_id", "risk_score", "verdict", "confidence", "obfuscation_risk", "behavior_risk", "semantic_risk")


def analyze_summary(spark, sf_dir: str) -> DataFrame:
    return analyze_prompts(spark, sf_dir).groupBy("verdict", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").cast("long").alias("risk"))


def analyze_explained(spark, sf_dir: str) -> DataFrame:
    """The reported form of an analysis: a line for each layer, and why the judge was or was not asked."""
    from .analyze import result

    out = result(analyze(corpus(spark, sf_dir, PROMPTS, bits=True), bits_col="bits"))
    line = lambda x: F.concat_ws("|", x["name"], x["risk"].cast("string"), x["details"], F.array_join(x["reasoning"], ";"))
    return out.select("prompt", "risk_score", F.array_join(F.transform("layers", line), "\n").alias("report"), F.col("layer_reasoning.fusion").alias("fusion"), F.col("layer_reasoning.triage").alias("triage"), F.col("llm_status.used").alias("llm_used"))


def screen_prompts(spark, sf_dir: str) -> DataFrame:
    return screen(corpus(spark, sf_dir, PROMPTS + SECRETS, bits=True), explain=False, bits_col="bits").select(*KEY, "verdict", "action", "reason")


REPLIES = [
    'Here: {"risk_score": 72, "verdict": "HIGH_RISK", "reasoning": "r", "detected_threats": ["x"]} ok', '{"risk_score": "80"}', '{"risk_score": 10.9, "verdict": "SAFE"}',
    "risk_score: 91 because", '{broken "risk_score": 65', "no idea", '{"verdict": "BLOCKED"}', '{"risk_score": "high", "verdict": "SAFE"}', '{"risk_score": -5}',
]


def judge_parse(spark, sf_dir: str) -> DataFrame:
    """Replies of a judge to each conversation's turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.posexplode(F.array(*[F.lit(r) for r in REPLIES])).alias("k", "reply"))
    j = judge.parsed_reply(F.col("reply"))
    return turns.withColumn("j", j).select(*KEY, "j.risk_score", "j.verdict", "j.reasoning", F.size("j.detected_threats").alias("threats"))


def judge_prompts(spark, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, PROMPTS).select(*KEY, T.payload_digest(judge.judge_prompt(F.col("text"), "Assess:")).alias("prompt_sha256"))


def judge_merge(spark, sf_dir: str) -> DataFrame:
    """Verdicts with a judge that answers some prompts and fails on others."""

    def fake(prompt: str) -> str | None:
        return '{"risk_score": 33, "verdict": "MEDIUM_RISK"}' if len(prompt) % 2 else None

    seen = analyze(corpus(spark, sf_dir, PROMPTS, bits=True), judge=fake, instructions="Assess:", explain=False, bits_col="bits")
    return seen.select(*KEY, "risk_score", "verdict", "confidence", "llm_used")


def judge_budget(spark, sf_dir: str) -> DataFrame:
    """A judge that may be asked 15 times: which prompts it is asked about, and that it fails on some uses its budget too."""
    rows = corpus(spark, sf_dir, PROMPTS).withColumn("asked", F.when(F.col("k") % 2 == 0, F.col("text")))
    seen = judge.call_judge(rows, "asked", lambda p: "yes" if len(p) % 2 else None, "Assess:", limit=15, order=KEY)
    return seen.select(*KEY, "limited", F.col("reply").isNotNull().alias("answered"))


def mask_keys(spark, sf_dir: str) -> DataFrame:
    key = F.substring(F.col("text"), F.lit(1), F.pmod("doc_id", F.lit(20)).cast("int"))
    return documents(spark, sf_dir).select("doc_id", T.mask_key(key).alias("masked"))


LABELS = ["google (default)", "openai", "openrouter: auto", "opencode-zen", "anthropic x", "other", ""]


def provider_parse(spark, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.pmod("doc_id", F.lit(len(LABELS))) + 1).cast("int")).alias("choice"))
    return rows.select("doc_id", T.provider_of(F.col("choice")).alias("provider"))


def rate_limit(spark, sf_dir: str) -> DataFrame:
    """At most 15 events of a type admitted in any 6 hours."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    return ratelimit.admit(events, "event_type", "ts", "event_id", 15, 6 * 3600).select("event_id", "admitted")


def rate_limit_hot(spark, sf_dir: str) -> DataFrame:
    """All events as the requests of one key, at most 15 in any 6 hours: it is beyond the limit throughout, without a pause."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit("all").alias("key"), "ts")
    return ratelimit.admit(events, "key", "ts", "event_id", 15, 6 * 3600).select("event_id", "admitted", "used")


def rate_status(spark, sf_dir: str) -> DataFrame:
    """The limiter's state after each key's last request."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    last = ratelimit.admit(events, "event_type", "ts", "event_id", 15, 6 * 3600).groupBy("event_type").agg(F.max_by("used", F.struct("ts", "event_id")).alias("used"))
    return last.select("event_type", ratelimit.status(F.col("used"), 15).alias("s")).select("event_type", "s.requests_used", "s.requests_remaining", "s.available")


NAMES = ["BLOCKED", "block", "Malicious", "attack", "safe", "benign", "OK", "HIGH", "highrisk", "medium", "UNCERTAIN", "MEDIUM_RISK", "odd", ""]


def _labelled(spark, sf_dir: str) -> DataFrame:
    """Pairs of expected and actual labels, from events, with latencies."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    pick = lambda by: F.element_at(F.array(*[F.lit(v) for v in NAMES]), (F.pmod(F.floor(F.col("event_id") / by), F.lit(len(NAMES))) + 1).cast("int"))
    return e.select("event_id", pick(1).alias("expected_verdict"), pick(14).alias("actual_verdict"), (F.col("event_id") % 3 == 0).alias("llm_used"), F.round("value", 2).alias("latency_ms"))


def verdict_normalize(spark, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("event_id", T.normalize_verdict(F.col("expected_verdict")).alias("label"))


def verdict_correct(spark, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("event_id", T.is_correct(F.col("expected_verdict"), F.col("actual_verdict")).alias("correct"))


def eval_metrics(spark, sf_dir: str) -> DataFrame:
    """Toxic labels as what is expected of the screening of documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("toxic") == 1, "ATTACK").otherwise("benign").alias("expected_verdict"))
    seen = gate(documents(spark, sf_dir)).select("doc_id", F.when(F.col("action") == "BLOCK", "BLOCKED").otherwise("SAFE").alias("actual_verdict"))
    rows = seen.join(labels, "doc_id", "left").select("expected_verdict", "actual_verdict", F.lit(False).alias("llm_used"), F.lit(1.0).alias("latency_ms"))
    return E.evaluate(rows).select("n", "has_expected", "tp", "tn", "fp", "fn", "correct_count", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def eval_latency(spark, sf_dir: str) -> DataFrame:
    names = ["avg_latency_ms", "avg_latency_without_llm", "avg_latency_with_llm", "llm_used_share", "llm_skipped_share", "accuracy", "precision", "recall", "f1"]
    return E.evaluate(_labelled(spark, sf_dir)).select("n", "tp", "tn", "fp", "fn", "correct_count", "llm_used", "llm_skipped", *[F.round(c, 6).alias(c) for c in names])


def prompt_truncate(spark, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.truncated(F.col("text")).alias("prompt"))


def results_rows(spark, sf_dir: str) -> DataFrame:
    """Rows of a batch as the results table has them."""
    rows = corpus(spark, sf_dir, PROMPTS, bits=True).withColumnRenamed("text", "prompt").withColumn("expected_verdict", F.element_at(F.array(*[F.lit(v) for v in NAMES]), (F.col("k") % len(NAMES) + 1).cast("int")))
    out = tables.results(analyze(rows, "prompt", explain=False, bits_col="bits"))
    return out.select("prompt", "expected_verdict", "actual_verdict", "risk_score", "confidence", "llm_used", "correct")


def _new_folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Prompts written as CSV and read back by the source."""
    path = _new_folder(spark, "csv")
    prompts = corpus(spark, sf_dir, PROMPTS).select(F.col("text").alias("prompt"), F.lit("SAFE").alias("expected_verdict"))
    prompts.write.csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_prompts(spark, path).select("prompt", "expected_verdict")


def results_sink(spark, sf_dir: str) -> DataFrame:
    """Results of documents as the CSV sink writes them, read back as text."""
    rows = analyze(documents(spark, sf_dir).select(F.col("text").alias("prompt"), F.lit("SAFE").alias("expected_verdict")), "prompt", explain=False)
    path = _new_folder(spark, "results")
    tables.write_results(tables.results(rows, F.lit(12.5)), path)
    back = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.select(T.payload_digest(F.col("prompt")).alias("prompt_sha256"), "expected_verdict", "actual_verdict", "risk_score", "confidence", "llm_used", "latency_ms", "correct")


def audit_sink(spark, sf_dir: str) -> DataFrame:
    """Audit records as the sink writes them, read back; all but their time."""
    path = _new_folder(spark, "audit")
    tables.write_audit(_gated(spark, sf_dir), path, snippets="sha256")
    return _audited(spark.read.schema(AUDIT).json(path))


AUDIT = "ts string, payload_sha256 string, action string, reason string, redacted string, findings array<struct<dtype: string, start: int, end: int, snippet: string, confidence: string>>, intent_verdict string, risk_score int, llm_used boolean"


def _audited(records: DataFrame) -> DataFrame:
    found = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["dtype"], f["start"], f["end"], f["snippet"], f["confidence"])), ",")
    return records.select("payload_sha256", "action", "reason", T.payload_digest(F.col("redacted")).alias("redacted_sha256"), found.alias("findings"), "intent_verdict", "risk_score", "llm_used")


def findings_json(spark, sf_dir: str) -> DataFrame:
    """Findings in the form in which they are handed on."""
    return _gated(spark, sf_dir).select("doc_id", F.to_json(S.findings(F.col("spans"))).alias("findings"))


def metrics_report(spark, sf_dir: str) -> DataFrame:
    """The evaluation as text: a row for each line. It is made of one row."""
    row = E.evaluate(_labelled(spark, sf_dir)).head()
    return spark.createDataFrame([(i, x) for i, x in enumerate(E.report(row.asDict()).split("\n"))], "i int, line string")


def _reported(spark, sf_dir: str) -> DataFrame:
    from .analyze import result

    return result(analyze(corpus(spark, sf_dir, PROMPTS, bits=True), bits_col="bits"))


def view_html(spark, sf_dir: str) -> DataFrame:
    """Analyses as people see them."""
    seen = _reported(spark, sf_dir)
    return seen.select("prompt", views.result_html(seen).alias("html"))


def view_trace(spark, sf_dir: str) -> DataFrame:
    seen = _reported(spark, sf_dir)
    return seen.select("prompt", views.trace(seen).alias("lines"))


def metrics_html(spark, sf_dir: str) -> DataFrame:
    """The evaluation as a table of HTML, made of one row."""
    row = E.evaluate(_labelled(spark, sf_dir)).head()
    return spark.createDataFrame([(views.report_html(E.report(row.asDict())),)], "html string")


def sem_top_two(spark, sf_dir: str) -> DataFrame:
    """The best two of each dimension's intents that has two."""
    rows, scores = _scored(spark, sf_dir, places=9)
    return rows.select("vec_id", *[semantic.top_two(own).alias(d) for d, own in scores.items() if len(own) > 1])


def fusion_reasons(spark, sf_dir: str) -> DataFrame:
    rows = _risks(spark, sf_dir).withColumn("e", fusion.signals(*[F.col(c) for c in ("o", "b", "s", "sc", "t", "tc")]))
    return rows.select("event_id", fusion.fusion_reason(F.col("e"), *fusion.fused(F.col("e"))).alias("reason"))


def _stream(spark, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).parquet(f"{sf_dir}/{table}.parquet*")


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def stream_screen(spark, sf_dir: str) -> DataFrame:
    """Documents as a stream, screened; the batches' results together."""
    out, ck = _new_folder(spark, "stream"), _new_folder(spark, "checkpoint")
    seen = screen_stream(_stream(spark, sf_dir, "documents").select("doc_id", "text"), explain=False).select("doc_id", "verdict", "action", "reason")
    _finished(seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
    return spark.read.schema(seen.schema).parquet(out)


def stream_audit(spark, sf_dir: str) -> DataFrame:
    """Documents as a stream, gated, and their audit records appended."""
    out, ck = _new_folder(spark, "stream-audit"), _new_folder(spark, "checkpoint")
    _finished(audit_stream(gate(_stream(spark, sf_dir, "documents").select("text")), out, ck, snippets="sha256").trigger(availableNow=True).start())
    return _audited(spark.read.schema(AUDIT).json(out))


def stream_limit(spark, sf_dir: str) -> DataFrame:
    """Events as a stream through the limiter with state. They come in four batches, a tenth of each with the batch after, and a last one far ahead moves the watermark past all.

    Each batch is the same number of files, of 10,000 rows at least where it is more than one, and the stream takes so many at a time.
    """
    source, out, ck = _new_folder(spark, "events"), _new_folder(spark, "stream-limit"), _new_folder(spark, "checkpoint")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    t = F.unix_micros("ts")
    first, last = events.agg(F.min(t), F.max(t)).head()
    step = (last - first) // 4 + 1
    place = F.coalesce(F.floor((t - first) / step) + (F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0).cast("int"), F.lit(0))
    fewest = min(events.agg(*[F.count_if(place == k) for k in range(5)]).head())
    files = max(1, min(spark.sparkContext.defaultParallelism, fewest // 10_000))
    ahead = [spark.range(0, files, 1, files).select(F.lit(-1).cast("long").alias("event_id"), F.lit("ahead").alias("event_type"), F.timestamp_micros(F.lit(last + 20 * step * k)).alias("ts")) for k in (1, 2)]
    for n, batch in enumerate([events.where(place == k).repartition(files) for k in range(5)] + ahead, 1):
        batch.write.mode("append").parquet(source)
        if (found := len(spark.read.schema(events.schema).parquet(source).inputFiles())) != n * files:
            raise RuntimeError(f"{found} files after {n} batches of {files}")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(source)
        seen = admit_stream(stream, "event_type", "ts", "event_id", 15, 6 * 3600, f"{step // 900 + 1} milliseconds", 6 * 3600)
        _finished(seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(seen.schema).parquet(out).where("id >= 0").select(F.col("id").alias("event_id"), "admitted")


def entry(spark, sf_dir: str) -> DataFrame:
    return gate_by_action(spark, sf_dir)


QUERIES = {f"det_{n.lower()}": _detector(n) for n, _ in P.DETECTORS} | {
    f.__name__: f
    for f in (
        span_merge, span_redact, gate_decision, gate_prompts, gate_policy, gate_by_action, gate_by_lang_source, findings_by_type, audit_digest, obf_normalized, obf_documents,
        beh_flags, beh_first_pattern, beh_score, sem_fallback, trf_fallback, trf_score, sem_centroid, sem_cosine, sem_rules, sem_confidence, fuse, triage, analyze_prompts,
        analyze_documents, analyze_summary, analyze_explained, screen_prompts, judge_parse, judge_prompts, judge_merge, judge_budget, mask_keys, provider_parse, rate_limit, rate_limit_hot, rate_status,
        verdict_normalize, verdict_correct, eval_metrics, eval_latency, prompt_truncate, results_rows, csv_roundtrip,
        results_sink, audit_sink, findings_json, metrics_report, sem_top_two, fusion_reasons, stream_screen, stream_audit, stream_limit, view_html, view_trace, metrics_html,
    )
} | {f"obf_{n}": _technique(n) for n in normalize.TECHNIQUES}
