"""Queries through models, judges and their settings, with their SQL: an embedder, a classifier, requests, a judge that is switched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import patterns as P
from ..functions.text import payload_digest
from ..operators import injection, semantic
from ..operators.gate import gate
from ..operators.judge import judge_from_env, requests
from ..sources import tables
from ..streaming.screening import audit_once, read_audit
from .analyze import Screening, analyze
from .corpus import PROMPTS, corpus, corpus_sql
from .oracle import KEYS, RULE_1, RULE_2, analyzed_sql, q
from .oracle import SQL as BASE
from .queries import AUDIT, KEY, _audited, _finished, _new_folder, _stream, documents

DIMENSIONS, SEED = 16, "projection"


def _embedder():
    return semantic.projection_embedder(DIMENSIONS, SEED)


def sem_embed(spark, sf_dir: str) -> DataFrame:
    """Embeddings of whole documents by a seeded projection of their words."""
    seen = semantic.embed(documents(spark, sf_dir).select("doc_id", "text"), "text", _embedder(), "e")
    return seen.select("doc_id", *[F.round(F.col("e")[i].cast("double"), 5).alias(f"e{i}") for i in range(DIMENSIONS)])


def sem_model(spark, sf_dir: str) -> DataFrame:
    """The semantic layer through an embedder: similarity to the intents' examples, rules and risk."""
    embedder = _embedder()
    rows = semantic.embed(corpus(spark, sf_dir, PROMPTS), "text", embedder, "e")
    own = semantic.intent_scores(F.col("e"), semantic.example_intents(embedder, P.INTENTS))
    names = [(d, i) for d, x in own.items() for i in x]
    rows = rows.select(*KEY, *[F.round(F.coalesce(own[d][i], F.lit(0.0)), 6).alias(f"s{n}") for n, (d, i) in enumerate(names)])
    scores: dict = {d: {} for d in own}
    for n, (d, i) in enumerate(names):
        scores[d][i] = F.col(f"s{n}")
    return rows.select(*KEY, *[f"s{n}" for n in range(len(names))], semantic.rule_risk(scores).alias("semantic_risk"), F.array_join(semantic.rules_fired(scores), ",").alias("rules"))


def trf_classify(spark, sf_dir: str) -> DataFrame:
    """The injection layer through a classifier of batches."""
    seen = injection.classify(corpus(spark, sf_dir, PROMPTS), "text", injection.embedding_classifier(_embedder(), P.INJECTION_WORDS))
    c = F.col("injection_confidence")
    return seen.select(*KEY, "is_injection", F.round(c, 6).alias("injection_confidence"), injection.injection_risk(F.col("is_injection"), c).alias("injection_risk"))


def single_prompts(spark, sf_dir: str) -> DataFrame:
    """Turns as single prompts, every third blank: blank ones are refused, the rest analyzed."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.lit(" \t\n")).otherwise(F.col("text")).alias("prompt"))
    return analyze(tables.nonblank(turns, "prompt"), "prompt", explain=False).select("conv_id", "turn", "risk_score", "verdict")


ENVIRONMENTS = [{}, {"OPENAI_API_KEY": "a"}, {"OPENROUTER_API_KEY": "b", "GEMINI_API_KEY": "c"}, {"LLM_PROVIDER": "anthropic", "OPENAI_API_KEY": "a"}, {"LLM_PROVIDER": "anthropic", "ANTHROPIC_API_KEY": "d", "LLM_MODEL": "m"}]


def judge_environments(spark, sf_dir: str) -> DataFrame:
    """What the judge of each of a few environments would send about each turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    out = None
    for i, env in enumerate(ENVIRONMENTS):
        one = requests(turns, "text", judge_from_env(env=env)).select("conv_id", "turn", F.lit(i).alias("env"), "request.provider", "request.url", "request.headers", payload_digest(F.col("request.payload")).alias("payload_sha256"))
        out = one if out is None else out.unionByName(one)
    return out


def judge_switched(spark, sf_dir: str) -> DataFrame:
    """A judge attached, replaced by another, and cleared: each third of the conversations is screened by what was there then."""
    screening, rows = Screening(explain=False, bits_col="bits"), corpus(spark, sf_dir, PROMPTS, bits=True)
    third = lambda k: screening.screen(rows.where(F.pmod("conv_id", F.lit(3)) == k)).select(*KEY, "risk_score", "verdict", "llm_used")
    screening.judge = lambda prompt: '{"risk_score": 90, "verdict": "BLOCKED"}'
    first = third(0)
    screening.judge = lambda prompt: '{"risk_score": 10, "verdict": "SAFE"}'
    second = third(1)
    screening.clear()
    return first.unionByName(second).unionByName(third(2))


def gate_sql(spark, sf_dir: str) -> DataFrame:
    """The gate written as SQL text, with the functions of the session's catalogue."""
    catalog.register(spark)
    view = f"documents_{uuid.uuid4().hex}"
    documents(spark, sf_dir).select("doc_id", "text").createTempView(view)
    return spark.sql(catalog.GATE.format(documents=view))


def stream_audit_once(spark, sf_dir: str) -> DataFrame:
    """Documents as a stream, gated; of payloads that come again one audit record."""
    out, ck = _new_folder(spark, "audit-once"), _new_folder(spark, "checkpoint")
    rows = _stream(spark, sf_dir, "documents").select("text", F.timestamp_seconds(F.pmod("doc_id", F.lit(1000)) + 1_700_000_000).alias("at"))
    _finished(audit_once(gate(rows), out, ck, "at", "1 day", snippets="sha256").trigger(availableNow=True).start())
    return _audited(read_audit(spark, out, AUDIT))


QUERIES = {f.__name__: f for f in (sem_embed, sem_model, trf_classify, single_prompts, judge_environments, judge_switched, gate_sql, stream_audit_once)}


def _embedded_sql(rows: str, keys: str) -> str:
    """keys, and e0 to the last, of rows with text."""
    digest = f"sha256('{SEED}:' || w)"
    parts = ", ".join(f"CAST('0x' || substr(h, {2 * i + 1}, 2) AS INTEGER) - 127.5::DOUBLE AS b{i}" for i in range(DIMENSIONS))
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return f"""(WITH r AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM {rows}), w AS (SELECT id, unnest({words}) AS w FROM r), c AS (SELECT id, w, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT w, {parts} FROM (SELECT w, {digest} AS h FROM (SELECT DISTINCT w FROM c))), s AS (SELECT id, {', '.join(f'sum(n * b{i}) AS e{i}' for i in range(DIMENSIONS))} FROM c JOIN b USING (w) GROUP BY id),
l AS (SELECT *, sqrt({' + '.join(f'e{i} * e{i}' for i in range(DIMENSIONS))}) AS l FROM s)
SELECT {keys}, {', '.join(f'coalesce(CAST(CASE WHEN l > 0 THEN e{i} / l ELSE 0 END AS FLOAT), 0)::DOUBLE AS e{i}' for i in range(DIMENSIONS))} FROM r LEFT JOIN l USING (id))"""


def _sql() -> dict[str, str]:
    prompts = corpus_sql(PROMPTS)
    embedder = _embedder()
    intents = semantic.example_intents(embedder, P.INTENTS)
    own = "[" + ", ".join(f"e{i}" for i in range(DIMENSIONS)) + "]"
    vector = lambda c: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in c) + "]"
    cosine = lambda c: f"CASE WHEN list_sum(list_transform({own}, lambda x: abs(x))) > 0 THEN list_cosine_similarity({own}, {vector(c)}) ELSE 0 END"
    scores = ", ".join(f"round({cosine(c)}, 6) AS s{n}" for n, c in enumerate(c for d in intents.values() for c in d.values()))
    rows = _embedded_sql(prompts, KEYS)
    # A classifier sees embeddings before they are stored as floats; at six places that makes no difference but at a border.
    words = [embedder([w])[0] for w in P.INJECTION_WORDS]
    mean = [sum(x) / len(words) for x in zip(*words)]
    length = sum(x * x for x in mean) ** 0.5
    exact = rows.replace("AS FLOAT)", "AS DOUBLE)")
    near = f"list_dot_product({own}, {vector([x / length for x in mean])})"
    payload = {
        1: """'{"messages": [{"content": ' || j || ', "role": "user"}], "model": "gpt-4o-mini", "temperature": 0.2}'""",
        2: """'{"contents": [{"parts": [{"text": ' || j || '}]}]}'""",
        4: """'{"max_tokens": 1024, "messages": [{"content": ' || j || ', "role": "user"}], "model": "m"}'""",
    }
    sent = {
        1: ("openai", "https://api.openai.com/v1/chat/completions", "Authorization"),
        2: ("google", "https://generativelanguage.googleapis.com/v1beta/models/gemini-2.5-flash:generateContent", "x-goog-api-key"),
        4: ("anthropic", "https://api.anthropic.com/v1/messages", "anthropic-version,x-api-key"),
    }
    pick = lambda n: "CASE env " + " ".join(f"WHEN {i} THEN {q(x[n])}" for i, x in sent.items()) + " END"
    asks = "NOT early AND NOT (risk >= 85 AND confidence = 'HIGH') AND conv_id % 3 < 2"
    return {
        "gate_sql": BASE["gate_decision"],
        "stream_audit_once": f"SELECT DISTINCT * FROM ({BASE['audit_sink']})",
        "sem_embed": f"SELECT doc_id, {', '.join(f'round(e{i}, 5) AS e{i}' for i in range(DIMENSIONS))} FROM {_embedded_sql('documents', 'doc_id')}",
        "sem_model": f"SELECT conv_id, turn, k, s0, s1, s2, s3, s4, CAST(CASE WHEN {RULE_1} THEN 95 WHEN {RULE_2} THEN 90 WHEN s1 > 0.75::DOUBLE THEN 60 WHEN s2 > 0.7::DOUBLE THEN 55 ELSE 0 END AS INTEGER) AS semantic_risk, array_to_string(list_filter([CASE WHEN {RULE_1} THEN 'Training Data Exfiltration' END, CASE WHEN {RULE_2} THEN 'Unfiltered PII Request' END], lambda x: x IS NOT NULL), ',') AS rules FROM (SELECT conv_id, turn, k, {scores} FROM {rows})",
        "trf_classify": f"SELECT conv_id, turn, k, x > 0.3::DOUBLE AS is_injection, round(c, 6) AS injection_confidence, CAST(CASE WHEN x > 0.3::DOUBLE AND c > 0.8::DOUBLE THEN 80 WHEN x > 0.3::DOUBLE THEN 60 ELSE 0 END AS INTEGER) AS injection_risk FROM (SELECT *, least(1, 0.5::DOUBLE + abs(x - 0.3::DOUBLE)) AS c FROM (SELECT conv_id, turn, k, {near} AS x FROM {exact}))",
        "single_prompts": f"SELECT conv_id, turn, CAST(risk_score AS INTEGER) AS risk_score, verdict FROM {analyzed_sql(chr(40) + 'SELECT conv_id, turn, text FROM conversations WHERE (conv_id + turn) % 3 <> 0 AND regexp_matches(text, ' + q(chr(92) + 'S') + '))')}",
        "judge_environments": f"WITH t AS (SELECT conv_id, turn, CAST(to_json(text) AS VARCHAR) AS j, text, CAST(v.env AS INTEGER) AS env FROM conversations, (VALUES (0), (1), (2), (3), (4)) AS v(env)) SELECT conv_id, turn, env, {pick(0)} AS provider, {pick(1)} AS url, {pick(2)} AS headers, sha256(CASE env {' '.join(f'WHEN {i} THEN {x}' for i, x in payload.items())} END) AS payload_sha256 FROM t",
        "judge_switched": f"SELECT {KEYS}, CAST(CASE WHEN {asks} THEN CASE conv_id % 3 WHEN 0 THEN 90 ELSE 10 END ELSE risk_score END AS INTEGER) AS risk_score, CASE WHEN {asks} THEN CASE conv_id % 3 WHEN 0 THEN 'BLOCKED' ELSE 'SAFE' END ELSE verdict END AS verdict, {asks} AS llm_used FROM {analyzed_sql(prompts)}",
    }


SQL = _sql()
