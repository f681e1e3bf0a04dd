"""DuckDB SQL for the queries, written from the same catalogues.

RE2 has no lookaround and its word ends are ASCII, so patterns are rewritten: a word
end becomes a character that is no letter, digit or underscore, or an end of text.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..operators.behavior import SIGNALS
from ..operators.fusion import TRIAGE
from ..operators.normalize import TECHNIQUES
from .analyze import EARLY, NO_JUDGE
from .corpus import PROMPTS, SECRETS, corpus_sql
from .queries import LABELS, NAMES, REPLIES

W = r"\p{L}\p{N}_"
LEFT, RIGHT = rf"(?:^|[^{W}])", rf"(?:$|[^{W}])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(body: str) -> str:
    """A behaviour's pattern for RE2."""
    body = body.replace(r"\w*", rf"[{W}]*")
    if r"\b.*\b" in body:
        body = body.replace(r"\b.*\b", rf"[^{W}\n](?:[^\n]*[^{W}\n])?")
    if body.startswith(r"\b"):
        body = LEFT + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + RIGHT
    return "(?i)" + body


def hit(col: str, body: str) -> str:
    return f"regexp_matches({col}, {q(re2(body))})"


RETRIEVAL = rf"(?s)(?:^|^[^{W}]|^.[^{W}]|(?:[^iI].|.[^nN])[^{W}]|..[^{W}\s])(?:" + P.RETRIEVAL.split(r"(?<!in\s)(")[1][: -len(r")\b")] + ")" + RIGHT
TARGET = P.TARGET.removeprefix(P.ANY_CASE)


# Detectors.
def _re(name: str) -> str:
    return "(?i)" + dict(P.DETECTORS)[name].removeprefix(P.ANY_CASE)


def cards_sql(text: str) -> str:
    """A list of structs s, e, o of card numbers, with spaces and dashes.

    RE2 cannot look around, so each character but digits is doubled: one half may be the end of one match and the other the
    beginning of the next. Offsets count such a character as half.
    """
    low, high = P.LUHN_DIGITS
    d = r"\p{Nd}"
    pattern = q(rf"(?:^|[^{d}])(?:[0-9](?:  |--)?){{12,18}}[0-9](?:--)?{d}(?:$|[^{d}])")
    twice = f"regexp_replace({text}, '([^{d}])', '\\1\\1', 'g')"
    halves = lambda x: f"(length({x}) + length(regexp_replace({x}, '[^{d}]', '', 'g'))) // 2"
    lead, trail = f"CASE WHEN regexp_matches(m, '^[^{d}]') THEN 1 ELSE 0 END", f"CASE WHEN regexp_matches(m, '[^{d}]$') THEN 1 ELSE 0 END"
    digits = "regexp_replace(y, '[^0-9]', '', 'g')"
    place = f"list_transform(range(1, length({digits}) + 1), lambda j: CAST(substr(reverse({digits}), j, 1) AS INT) * CASE WHEN j % 2 = 0 THEN 2 ELSE 1 END)"
    ok = f"length({digits}) BETWEEN {low} AND {high} AND list_sum(list_transform({place}, lambda d: CASE WHEN d > 9 THEN d - 9 ELSE d END)) % 10 = 0"
    found, gaps = f"regexp_extract_all({twice}, {pattern})", f"regexp_split_to_array({twice}, {pattern})"
    before = f"array_to_string(list_transform(range(1, i + 1), lambda j: ({gaps})[j] || CASE WHEN j < i THEN ({found})[j] ELSE '' END), '')"
    one = f"list_transform([({found})[i]], lambda m: {{'s': CAST({halves(f'({before} || substr(m, 1, {lead}))')} AS BIGINT), 'n': CAST({halves(f'substr(m, 1 + {lead}, length(m) - {lead} - {trail})')} AS BIGINT)}})[1]"
    spans = f"list_transform(list_transform(range(1, len({found}) + 1), lambda i: {one}), lambda x: {{'s': x.s, 'e': x.s + x.n, 'o': 0}})"
    checked = f"list_filter({spans}, lambda x: len(list_filter([substr({text}, x.s + 1, x.e - x.s)], lambda y: {ok})) > 0)"
    return f"CASE WHEN regexp_matches({twice}, {pattern}) THEN {checked} ELSE [] END"


def spans_sql(text: str, name: str) -> str:
    """A list of structs s, e, o of a detector's spans."""
    if name == "CREDIT_CARD":
        return cards_sql(text)
    order = [n for n, _ in P.DETECTORS].index(name)
    pattern = q(_re(name))
    lens = lambda x, n: f"coalesce(list_sum(list_transform({x}[1:{n}], lambda z: length(z))), 0)"
    found, gaps = f"regexp_extract_all({text}, {pattern})", f"regexp_split_to_array({text}, {pattern})"
    spans = f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': CAST({lens(gaps, 'i')} + {lens(found, 'i - 1')} AS BIGINT), 'e': CAST({lens(gaps, 'i')} + {lens(found, 'i')} AS BIGINT), 'o': {order}}})"
    return f"CASE WHEN regexp_matches({text}, {pattern}) THEN {spans} ELSE [] END"


def detector_sql(name: str) -> str:
    def one(rows: str, a: str, b: str) -> str:
        return f"SELECT {a} AS a, {b} AS b, {spans_sql('text', name)} AS s FROM {rows}"

    sums = "CAST(coalesce(list_sum(list_transform(s, lambda x: x.s)), 0) AS BIGINT) AS starts, CAST(coalesce(list_sum(list_transform(s, lambda x: x.e)), 0) AS BIGINT) AS ends"
    return f"WITH t AS ({one('documents', 'doc_id', 'CAST(-1 AS BIGINT)')} UNION ALL {one(corpus_sql(SECRETS), 'conv_id * 1000 + turn', 'CAST(k AS BIGINT)')}) SELECT a, b, CAST(len(s) AS INTEGER) AS n, {sums} FROM t"


def gated_sql(rows: str, keep: str = "*") -> str:
    """Rows with kept spans k, redacted, key (a live credential) and n."""
    names = [n for n, _ in P.DETECTORS]
    every = " || ".join(f"({spans_sql('text', n)})" for n in names)
    fold = "list_reduce(list_transform(a, lambda x: [x]), lambda acc, x: CASE WHEN x[1].s < acc[len(acc)].e THEN acc ELSE acc || x END)"
    first = min(names.index(n) for n in P.KEY_TYPES)
    return f"""(WITH g1 AS (SELECT {keep}, list_transform(list_sort(list_transform({every}, lambda x: {{'s': x.s, 'm': x.s - x.e, 'o': x.o, 'e': x.e}})), lambda x: {{'s': x.s, 'e': x.e, 'o': x.o}}) AS a FROM {rows}),
g2 AS (SELECT *, CASE WHEN len(a) > 0 THEN {fold} ELSE [] END AS k FROM g1)
SELECT *, len(k) AS n, len(list_filter(k, lambda x: x.o >= {first})) > 0 AS key,
 CASE WHEN len(k) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(k) + 1), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE k[i - 1].e + 1 END, k[i].s - CASE WHEN i = 1 THEN 0 ELSE k[i - 1].e END) || '{P.REDACTED}'), '') || substr(text, k[len(k)].e + 1) END AS redacted FROM g2)"""


def action_sql(block: str = "FALSE", keys: bool = True, redact: str = "REDACT") -> str:
    key = "key" if keys else "FALSE"
    return f"""CASE WHEN {block} THEN 'BLOCK' WHEN {key} THEN 'BLOCK' WHEN n > 0 THEN '{redact}' ELSE 'ALLOW' END AS action,
 CASE WHEN {block} THEN 'High-risk intent' WHEN {key} THEN 'Live credential found' WHEN n > 0 THEN n || ' sensitive item(s) found' ELSE 'Clean' END AS reason"""


# Obfuscation, as a chain of SELECTs.
def normalized_sql(rows: str) -> str:
    two = P.SYMBOLS_BETWEEN_LETTERS.replace("(?=[a-zA-Z])", "([a-zA-Z])")
    strip = P.UNICODE
    run, letter, gate = (x.removeprefix(strip) for x in (P.QUOTED_RUN, P.QUOTED_LETTER, P.QUOTED_GATE))
    spaced = P.SPACED_LETTERS.removeprefix(strip)
    joined = r"lower(regexp_replace({}, '\s+', '', 'g'))"
    words = " OR ".join(f"contains({joined.format('m')}, '{w}')" for w in P.SPACED_WORDS)
    leet = "'0134578@$'"
    return f"""(WITH n0 AS (SELECT * FROM {rows}),
n1 AS (SELECT *, regexp_matches(text, {q(two)}) AS h1, regexp_replace(regexp_replace(text, {q(two)}, '\\1\\3', 'g'), {q(two)}, '\\1\\3', 'g') AS t1 FROM n0),
n2 AS (SELECT *, CASE WHEN regexp_matches(text, {q(gate)}) AND len(regexp_extract_all(t1, {q(letter)}, 1)) >= 3 AND regexp_matches(t1, {q(run)}) THEN regexp_extract(t1, {q(run)}) END AS r FROM n1),
n3 AS (SELECT *, CASE WHEN r IS NULL THEN t1 ELSE substr(t1, 1, strpos(t1, r) - 1) || array_to_string(regexp_extract_all(t1, {q(letter)}, 1), '') || substr(t1, strpos(t1, r) + length(r)) END AS t2,
  list_filter(regexp_extract_all(text, {q(spaced)}), lambda m: {words})[1] AS m3 FROM n2),
n4 AS (SELECT *, CASE WHEN m3 IS NULL THEN t2 ELSE replace(t2, m3, {joined.format('m3')}) END AS t3 FROM n3),
n5 AS (SELECT *, regexp_matches(t3, {q(P.LATEX_TEXT)}) AS h4, regexp_replace(t3, {q(P.LATEX_TEXT)}, '\\1', 'g') AS t4 FROM n4),
n6 AS (SELECT *, translate(t4, {leet}, 'oieastbas') AS t5 FROM n5),
n7 AS (SELECT *, translate(t5, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(160), '') AS normalized FROM n6)
SELECT *, list_filter([CASE WHEN h1 THEN '{TECHNIQUES[0]}' END, CASE WHEN r IS NOT NULL THEN '{TECHNIQUES[1]}' END, CASE WHEN m3 IS NOT NULL THEN '{TECHNIQUES[2]}' END,
 CASE WHEN h4 THEN '{TECHNIQUES[3]}' END, CASE WHEN t4 <> t5 THEN '{TECHNIQUES[4]}' END, CASE WHEN t5 <> normalized THEN '{TECHNIQUES[5]}' END], lambda x: x IS NOT NULL) AS techniques FROM n7)"""


def behaved_sql(rows: str, col: str = "text") -> str:
    flags = ", ".join(f"({' OR '.join(hit(col, b) for _, b in bodies)}) AS has_{s}" for s, (_, _, bodies) in zip(SIGNALS, P.BEHAVIOURS))
    strong = " OR ".join(f"contains(lower({col}), '{w}')" for w in P.STRONG_TARGETS)
    return f"""(WITH b1 AS (SELECT *, {flags}, regexp_matches(lower({col}), {q(RETRIEVAL)}) AS has_retrieval, regexp_matches(lower({col}), {q(TARGET)}) AS has_target, ({strong}) AS strong FROM {rows})
SELECT *, CAST(CASE WHEN NOT has_retrieval AND NOT has_role AND NOT has_disclosure AND NOT has_jailbreak THEN 0 WHEN has_disclosure THEN 88
 WHEN has_jailbreak AND (has_role OR has_unfiltered OR has_retrieval) THEN 90 WHEN has_role AND (has_retrieval OR has_target) THEN 78 WHEN has_jailbreak THEN 72
 WHEN has_retrieval AND has_target AND strong THEN 85 WHEN has_retrieval AND has_target THEN 65 WHEN has_unfiltered AND (has_retrieval OR has_target) THEN 70 ELSE 0 END AS INTEGER) AS behavior_risk,
 CASE WHEN NOT has_retrieval AND NOT has_role AND NOT has_disclosure AND NOT has_jailbreak THEN 'benign override' WHEN has_disclosure THEN 'disclosure'
 WHEN has_jailbreak AND (has_role OR has_unfiltered OR has_retrieval) THEN 'jailbreak with overlay' WHEN has_role AND (has_retrieval OR has_target) THEN 'role takeover for data' WHEN has_jailbreak THEN 'bare jailbreak'
 WHEN has_retrieval AND has_target AND strong THEN 'retrieval of strong target' WHEN has_retrieval AND has_target THEN 'retrieval of weak target' WHEN has_unfiltered AND (has_retrieval OR has_target) THEN 'unfiltered request' ELSE 'no signal' END AS behavior_branch FROM b1)"""


def any_of(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


def keyword_risk_sql(col: str) -> str:
    t, p = any_of(col, P.FALLBACK_TRAINING), any_of(col, P.FALLBACK_PII)
    return f"CAST(CASE WHEN {t} AND {p} THEN 90 WHEN {t} THEN 55 ELSE 0 END AS INTEGER)"


def injection_sql(col: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({col}), '{w}') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END" for w in P.INJECTION_WORDS) + ")"


def fused_sql(rows: str) -> str:
    """rows with o, b, s, sc, t, tc: adds risk and confidence."""
    pairs = [("o", "0.8::DOUBLE"), ("b", "0.85::DOUBLE"), ("s", "CAST(sc AS DOUBLE)"), ("t", "CAST(tc AS DOUBLE)")]
    rc = " + ".join(f"CASE WHEN {r} > 0 THEN {r} * {c} ELSE 0.0::DOUBLE END" for r, c in pairs)
    cc = " + ".join(f"CASE WHEN {r} > 0 THEN {c} ELSE 0.0::DOUBLE END" for r, c in pairs)
    sure = "greatest(0, " + ", ".join(f"CASE WHEN {r} > 0 AND {c} > 0.8::DOUBLE THEN {r} ELSE 0 END" for r, c in pairs) + ")"
    top = "greatest(" + ", ".join(r for r, _ in pairs) + ")"
    low = "least(" + ", ".join(f"CASE WHEN {r} > 0 THEN {r} ELSE 1000 END" for r, _ in pairs) + ")"
    return f"""(WITH f1 AS (SELECT *, {sure} AS sure, {rc} AS rc, {cc} AS cc, {top} AS top, {low} AS low FROM {rows})
SELECT *, CAST(CASE WHEN top = 0 THEN 0 WHEN sure >= 40 THEN sure WHEN cc > 0 THEN trunc(rc / cc) ELSE top END AS INTEGER) AS risk,
 CASE WHEN top = 0 OR sure >= 70 THEN 'HIGH' WHEN sure >= 40 THEN 'MEDIUM' WHEN top - low < 25 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM f1)"""


def verdict_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {least} THEN '{v}'" for least, v in P.VERDICTS) + " ELSE 'SAFE' END"


def analyzed_sql(rows: str) -> str:
    """rows with text: adds the layers, risk_score, verdict, confidence, early."""
    seen = behaved_sql(f"(SELECT *, CASE WHEN len(techniques) > 0 THEN 15 ELSE 0 END AS o FROM {normalized_sql(rows)})", "normalized")
    signals = f"(SELECT *, behavior_risk AS b, {keyword_risk_sql('normalized')} AS s, 0.6::DOUBLE AS sc, 0 AS t, {injection_sql('normalized')} AS tc FROM {seen})"
    return f"""(SELECT *, b >= 85 AS early, CASE WHEN b >= 85 THEN b ELSE risk END AS risk_score, CASE WHEN b >= 85 OR (risk >= 85 AND confidence = 'HIGH') THEN 'BLOCKED' ELSE {verdict_sql('risk')} END AS verdict,
 CASE WHEN b >= 85 THEN 'HIGH' ELSE confidence END AS sure_of FROM {fused_sql(signals)})"""


def normal(col: str) -> str:
    return "CASE " + " ".join(f"WHEN upper({col}) IN ({', '.join(q(n) for n in names)}) THEN '{v}'" for v, names in P.VERDICT_ALIASES.items()) + f" ELSE upper({col}) END"


def evaluated_sql(rows: str) -> str:
    return f"""(WITH e0 AS (SELECT *, coalesce(expected_verdict, '') <> '' AS l, coalesce({normal('expected_verdict')}, '') AS e, {normal('actual_verdict')} AS a FROM {rows}),
e1 AS (SELECT count(*) AS n, bool_or(l) AS has_expected, count(*) FILTER (l AND e IN ('BLOCKED', 'HIGH_RISK') AND a IN ('BLOCKED', 'HIGH_RISK')) AS tp, count(*) FILTER (l AND e NOT IN ('BLOCKED', 'HIGH_RISK') AND a NOT IN ('BLOCKED', 'HIGH_RISK')) AS tn,
 count(*) FILTER (l AND e NOT IN ('BLOCKED', 'HIGH_RISK') AND a IN ('BLOCKED', 'HIGH_RISK')) AS fp, count(*) FILTER (l AND e IN ('BLOCKED', 'HIGH_RISK') AND a NOT IN ('BLOCKED', 'HIGH_RISK')) AS fn,
 count(*) FILTER (l AND (e = a OR (e = 'BLOCKED' AND a = 'HIGH_RISK'))) AS correct_count, count(*) FILTER (llm_used) AS llm_used, count(*) FILTER (NOT llm_used) AS llm_skipped,
 coalesce(avg(latency_ms), 0) AS avg_latency_ms, coalesce(avg(latency_ms) FILTER (NOT llm_used), 0) AS avg_latency_without_llm, coalesce(avg(latency_ms) FILTER (llm_used), 0) AS avg_latency_with_llm FROM e0),
e2 AS (SELECT *, CASE WHEN n > 0 THEN (tp + tn)::DOUBLE / n ELSE 0 END AS accuracy, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
 CASE WHEN n > 0 THEN llm_used::DOUBLE / n ELSE 0 END AS llm_used_share, CASE WHEN n > 0 THEN llm_skipped::DOUBLE / n ELSE 0 END AS llm_skipped_share FROM e1)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM e2)"""


def pick(values: list, by: str) -> str:
    return f"[{', '.join(q(v) if isinstance(v, str) else str(v) for v in values)}][CAST(({by}) % {len(values)} AS BIGINT) + 1]"


RISKS = f"(SELECT event_id, {pick([0, 15], 'event_id')} AS o, {pick([0, 65, 70, 72, 78], 'event_id // 2')} AS b, {pick([0, 55, 60, 90, 95], 'event_id // 10')} AS s, {pick(['0.5', '0.6', '0.75', '0.85'], 'event_id // 50')}::DOUBLE AS sc, {pick([0, 60, 80], 'event_id // 200')} AS t, {pick(['0.3', '0.55', '0.9'], 'event_id // 600')}::DOUBLE AS tc FROM events)"
LABELLED = f"(SELECT event_id, {pick(NAMES, 'event_id')} AS expected_verdict, {pick(NAMES, 'event_id // 14')} AS actual_verdict, event_id % 3 = 0 AS llm_used, round(value, 2) AS latency_ms FROM events)"
REASONS = f"""CASE WHEN risk >= 85 AND confidence = 'HIGH' THEN {q(TRIAGE['block'])} WHEN risk >= 85 THEN {q(TRIAGE['confirm'])}
 WHEN risk <= 20 THEN {q(TRIAGE['last look'])} ELSE {q(TRIAGE['decide'])} END"""
KEYS = "conv_id, turn, CAST(k AS INTEGER) AS k"
UNIT = """WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS n FROM m GROUP BY label)"""
SCORED = f"""{UNIT}, s AS (SELECT vec_id, {', '.join(f"coalesce(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM c WHERE label = {k})), 6), 0) AS s{k}" for k in range(5))} FROM embeddings)"""
RULE_1, RULE_2 = "(s0 >= 0.65::DOUBLE AND (s2 >= 0.6::DOUBLE OR s3 >= 0.6::DOUBLE))", "(s3 >= 0.6::DOUBLE AND s4 >= 0.65::DOUBLE)"
LIMITED = """WITH k AS (SELECT event_type, list(event_id ORDER BY ts, event_id) AS ids, list(epoch_us(ts) ORDER BY ts, event_id) AS ts FROM events GROUP BY event_type),
a AS (SELECT event_type, ids, ts, list_reduce(list_transform(range(1, len(ids) + 1), lambda i: [i]), lambda acc, x: CASE WHEN len(list_filter(acc[-15:], lambda j: ts[x[1]] - ts[j] <= 21600000000)) < 15 THEN acc || x ELSE acc END) AS adm FROM k)"""


def judged_sql() -> str:
    body = "regexp_extract(reply, '(?s)\\{.*\\}')"
    raw = "json_extract_string(j, '$.risk_score')"
    whole = f"CASE WHEN json_extract(j, '$.risk_score') IS NULL THEN 50 WHEN json_type(j, '$.risk_score') = 'VARCHAR' THEN TRY_CAST(CASE WHEN regexp_full_match({raw}, '\\s*[+-]?[0-9]+\\s*') THEN trim({raw}) END AS INTEGER) ELSE CAST(trunc(TRY_CAST({raw} AS DOUBLE)) AS INTEGER) END"
    loose = f"coalesce(TRY_CAST(nullif(regexp_extract(reply, {q(P.JUDGE_SCORE)}, 1), '') AS INTEGER), 50)"
    rows = ", ".join(f"({k}, {q(r)})" for k, r in enumerate(REPLIES))
    return f"""WITH r AS (SELECT conv_id, turn, k, reply, {body} AS b FROM conversations, (VALUES {rows}) AS v(k, reply)),
p AS (SELECT *, CASE WHEN json_valid(b) THEN b::JSON END AS j FROM r), s AS (SELECT *, CASE WHEN j IS NOT NULL THEN {whole} END AS w, {loose} AS lo FROM p)
SELECT {KEYS}, CAST(coalesce(w, lo) AS INTEGER) AS risk_score, CASE WHEN w IS NOT NULL THEN coalesce(json_extract_string(j, '$.verdict'), 'MEDIUM_RISK') ELSE {verdict_sql('lo')} END AS verdict,
 CASE WHEN w IS NOT NULL THEN coalesce(json_extract_string(j, '$.reasoning'), 'LLM analysis') ELSE substr(reply, 1, 200) END AS reasoning,
 CAST(CASE WHEN w IS NOT NULL THEN coalesce(json_array_length(j, '$.detected_threats'), 0) ELSE 0 END AS INTEGER) AS threats FROM s"""


def explained_sql(rows: str) -> str:
    """The reported layers of analyzed rows."""
    drop = "lambda x: x IS NOT NULL"
    named = ", ".join("CASE " + " ".join(f"WHEN {hit('normalized', b)} THEN {q(f'{category}: {name} by {i}')}" for i, b in bodies) + " END" for category, name, bodies in P.BEHAVIOURS)
    flags = " || ' ' || ".join(f"'{s}=' || CASE WHEN has_{s} THEN 'True' ELSE 'False' END" for s in ("retrieval", "target", *SIGNALS))
    layers = [
        "'obfuscation|' || o || '|' || CASE WHEN len(techniques) > 0 THEN array_to_string(techniques, ', ') ELSE 'none' END || '|' || array_to_string(['read as: ' || substr(normalized, 1, 80)] || list_transform(techniques, lambda x: 'undone: ' || x), ';')",
        f"'behaviour|' || b || '|' || len(named) || ' found|' || array_to_string(named || ['signals: ' || {flags}, 'decided by: ' || behavior_branch || ', risk ' || b], ';')",
    ]
    more = ["'semantic|' || s || '|0 rules hold|'", "'injection|0|' || CASE WHEN tc > 0.5 THEN 'likely' ELSE 'unlikely' END || '|' || printf('certainty %.3f', tc)"]
    return f"""(SELECT *, CASE WHEN early THEN array_to_string([{', '.join(layers)}], chr(10)) ELSE array_to_string([{', '.join(layers + more)}], chr(10)) END AS report
 FROM (SELECT *, list_filter([{named}], {drop}) AS named FROM {rows}))"""


def fusion_reason_sql() -> str:
    pairs = [("o", "0.8::DOUBLE"), ("b", "0.85::DOUBLE"), ("s", "sc"), ("t", "tc")]
    each = ", ".join(f"CASE WHEN {r} > 0 THEN printf('risk=%d@conf=%.2f', CAST({r} AS INTEGER), CAST({c} AS DOUBLE)) END" for r, c in pairs)
    return f"CASE WHEN top = 0 THEN 'all layers silent' ELSE '[' || array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ', ') || '] -> ' || risk || ', ' || confidence END"


def report_sql() -> str:
    share = lambda c: f"printf('%.1f %%', 100 * {c})"
    pad = lambda name: q(f"{name:<21}")
    lines = ["'evaluated prompts    ' || n"] + [f"{pad(c)} || {share(c)}" for c in ("accuracy", "precision", "recall", "f1")]
    lines += [f"{pad(name)} || {c}" for name, c in (("attacks found", "tp"), ("attacks missed", "fn"), ("harmless let pass", "tn"), ("harmless stopped", "fp"))]
    lines += [f"{pad(name)} || {c} || ' (' || {share(c + '_share')} || ')'" for name, c in (("judged", "llm_used"), ("not judged", "llm_skipped"))]
    lines += [f"{pad(name)} || printf('%.0f', {c})" for name, c in (("mean ms", "avg_latency_ms"), ("mean ms, judged", "avg_latency_with_llm"), ("mean ms, not judged", "avg_latency_without_llm"))]
    return f"SELECT CAST(i - 1 AS INTEGER) AS i, lines[i] AS line FROM (SELECT [{', '.join(lines)}] AS lines FROM {evaluated_sql(LABELLED)}), unnest(range(1, {len(lines) + 1})) AS u(i)"


def build() -> dict[str, str]:
    prompts, secrets = corpus_sql(PROMPTS), corpus_sql(SECRETS)
    docs, analyzed = gated_sql("documents", "*"), analyzed_sql(prompts)
    normalized, behaved = normalized_sql(prompts), behaved_sql(prompts)
    first = ", ".join(
        "CASE " + " ".join(f"WHEN {hit('text', b)} THEN '{name}={i}'" for i, b in bodies) + " END" for _, name, bodies in P.BEHAVIOURS
    )
    named = ", ".join(f"CASE WHEN has_{s} THEN '{b}' END" for s, (_, b, _) in zip(SIGNALS, P.BEHAVIOURS))
    drop = "lambda x: x IS NOT NULL"
    blocking = "verdict IN ('BLOCKED', 'HIGH_RISK')"
    policy = f"(SELECT doc_id, text, {pick(['SAFE', 'MEDIUM_RISK', 'HIGH_RISK', 'BLOCKED', 'WHATEVER'], 'doc_id')} AS verdict FROM documents)"
    screened = f"(SELECT conv_id, turn, k, text, verdict FROM {analyzed_sql(corpus_sql(PROMPTS + SECRETS))})"
    key = "substr(text, 1, CAST(doc_id % 20 AS INTEGER))"
    provider = "CASE WHEN c LIKE 'google%' THEN 'google' " + " ".join(f"WHEN c LIKE '{p}%' THEN '{p}'" for p in sorted(P.PROVIDERS, key=len, reverse=True)) + " ELSE 'google' END"
    sort2 = lambda a, b: f"((greatest({a}, {b}) - least({a}, {b})) * 0.4::DOUBLE + greatest({a}, {b}) * 0.6::DOUBLE)"
    judged = "CASE WHEN length('Assess:' || chr(10) || chr(10) || 'PROMPT TO ANALYZE:' || chr(10) || normalized) % 2 = 1"
    ask = "NOT early AND NOT (risk >= 85 AND confidence = 'HIGH')"
    out = {f"det_{n.lower()}": detector_sql(n) for n, _ in P.DETECTORS}
    out |= {f"obf_{t}": f"SELECT {KEYS}, list_contains(techniques, '{t}') AS found FROM {normalized}" for t in TECHNIQUES}
    kinds = "[" + ", ".join(q(n) for n, _ in P.DETECTORS) + "]"
    out |= {
        "span_merge": f"SELECT {KEYS}, array_to_string(list_transform(list_transform(g.k_, lambda x: x), lambda x: {kinds}[x.o + 1] || ':' || x.s || ':' || x.e), ',') AS kept FROM (SELECT conv_id, turn, kk AS k, k AS k_ FROM {gated_sql(f'(SELECT conv_id, turn, k AS kk, text FROM {secrets})')}) g",
        "span_redact": f"SELECT conv_id, turn, CAST(kk AS INTEGER) AS k, redacted FROM {gated_sql(f'(SELECT conv_id, turn, k AS kk, text FROM {secrets})')}",
        "gate_decision": f"SELECT doc_id, {action_sql()}, CAST(n AS INTEGER) AS n_findings, sha256(redacted) AS redacted_sha256 FROM {docs}",
        "gate_prompts": f"SELECT conv_id, turn, CAST(kk AS INTEGER) AS k, {action_sql(keys=False, redact='QUARANTINE')} FROM {gated_sql(f'(SELECT conv_id, turn, k AS kk, text FROM {secrets})')}",
        "gate_policy": f"SELECT doc_id, verdict, {action_sql(block=blocking)}, CASE WHEN verdict = 'MEDIUM_RISK' OR key THEN 'BLOCK' WHEN n > 0 THEN 'REDACT' ELSE 'ALLOW' END AS own_action FROM {gated_sql(policy)}",
        "gate_by_action": f"SELECT action, count(*) AS n, CAST(sum(n) AS BIGINT) AS findings FROM (SELECT n, {action_sql()} FROM {docs}) GROUP BY action",
        "gate_by_lang_source": f"SELECT lang, source, action, count(*) AS n FROM (SELECT lang, source, {action_sql()} FROM {docs}) GROUP BY ALL",
        "findings_by_type": f"SELECT {kinds}[u.x.o + 1] AS dtype, count(*) AS n FROM {docs}, unnest(k) AS u(x) GROUP BY 1",
        "audit_digest": f"SELECT sha256(text) AS payload_sha256, {action_sql()}, 'SAFE' AS intent_verdict, CAST(0 AS INTEGER) AS risk_score, FALSE AS llm_used FROM {docs}",
        "obf_normalized": f"SELECT {KEYS}, normalized, array_to_string(techniques, ',') AS techniques, len(techniques) > 0 AS obfuscation_detected, CAST(CASE WHEN len(techniques) > 0 THEN 15 ELSE 0 END AS INTEGER) AS obfuscation_risk FROM {normalized}",
        "obf_documents": f"SELECT doc_id, sha256(normalized) AS normalized_sha256, array_to_string(techniques, ',') AS techniques FROM {normalized_sql('documents')}",
        "beh_flags": f"SELECT {KEYS}, {', '.join(f'has_{s}' for s in (*SIGNALS, 'retrieval', 'target'))}, has_training AND (has_pii OR has_unfiltered) AS has_combination FROM {behaved}",
        "beh_first_pattern": f"SELECT {KEYS}, array_to_string(list_filter([{first}], {drop}), ',') AS patterns FROM {prompts}",
        "beh_score": f"SELECT {KEYS}, behavior_risk, behavior_branch, array_to_string(list_filter([{named}], {drop}), ',') AS behaviors FROM {behaved}",
        "sem_fallback": f"SELECT {KEYS}, {keyword_risk_sql('text')} AS semantic_risk FROM {prompts}",
        "trf_fallback": f"SELECT {KEYS}, {injection_sql('text')} AS injection_confidence, {injection_sql('text')} > 0.5 AS is_injection, CAST(0 AS INTEGER) AS injection_risk FROM {prompts}",
        "trf_score": "SELECT vec_id, CAST(CASE WHEN label % 2 = 0 AND (vec_id % 100)::DOUBLE / 100 > 0.8::DOUBLE THEN 80 WHEN label % 2 = 0 THEN 60 ELSE 0 END AS INTEGER) AS injection_risk FROM embeddings",
        "sem_centroid": f"{UNIT} SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m / n, 6) AS x FROM m JOIN c USING (label)",
        "sem_cosine": f"{SCORED} SELECT * FROM s",
        "sem_rules": f"{SCORED} SELECT vec_id, CAST(CASE WHEN {RULE_1} THEN 95 WHEN {RULE_2} THEN 90 WHEN s1 > 0.75::DOUBLE THEN 60 WHEN s2 > 0.7::DOUBLE THEN 55 ELSE 0 END AS INTEGER) AS semantic_risk, array_to_string(list_filter([CASE WHEN {RULE_1} THEN 'Training Data Exfiltration' END, CASE WHEN {RULE_2} THEN 'Unfiltered PII Request' END], {drop}), ',') AS rules FROM s",
        "sem_confidence": f"{SCORED} SELECT vec_id, round(({sort2('s0', 's1')} + {sort2('s2', 's3')}) / 2, 5) AS confidence FROM s",
        "fuse": f"SELECT event_id, risk, confidence FROM {fused_sql(RISKS)}",
        "triage": f"SELECT event_id, {REASONS} AS reason, {verdict_sql('risk')} AS verdict, risk >= 85 AND confidence = 'HIGH' AS blocked FROM {fused_sql(RISKS)}",
        "analyze_prompts": f"SELECT {KEYS}, risk_score, verdict, sure_of AS confidence, early AS early_block FROM {analyzed}",
        "analyze_documents": f"SELECT doc_id, risk_score, verdict, sure_of AS confidence, CAST(o AS INTEGER) AS obfuscation_risk, behavior_risk, s AS semantic_risk FROM {analyzed_sql('documents')}",
        "analyze_summary": f"SELECT verdict, sure_of AS confidence, count(*) AS n, CAST(sum(risk_score) AS BIGINT) AS risk FROM {analyzed} GROUP BY 1, 2",
        "screen_prompts": f"SELECT conv_id, turn, CAST(kk AS INTEGER) AS k, verdict, {action_sql(block=blocking)} FROM {gated_sql(f'(SELECT conv_id, turn, k AS kk, text, verdict FROM {screened})')}",
        "judge_parse": judged_sql(),
        "judge_prompts": f"SELECT {KEYS}, sha256('Assess:' || chr(10) || chr(10) || 'PROMPT TO ANALYZE:' || chr(10) || text) AS prompt_sha256 FROM {prompts}",
        "judge_merge": f"SELECT {KEYS}, CASE WHEN {ask} THEN {judged} THEN 33 ELSE risk_score END ELSE risk_score END AS risk_score, CASE WHEN {ask} THEN {judged} THEN 'MEDIUM_RISK' ELSE verdict END ELSE verdict END AS verdict, sure_of AS confidence, {ask} AND ({judged} THEN TRUE ELSE FALSE END) AS llm_used FROM {analyzed}",
        "judge_budget": f"WITH t AS (SELECT {KEYS}, text, row_number() OVER (PARTITION BY k % 2 ORDER BY conv_id, turn, k) AS i FROM {prompts}) SELECT conv_id, turn, k, k % 2 = 0 AND i > 15 AS limited, k % 2 = 0 AND i <= 15 AND length('Assess:' || chr(10) || chr(10) || 'PROMPT TO ANALYZE:' || chr(10) || text) % 2 = 1 AS answered FROM t",
        "mask_keys": f"SELECT doc_id, CASE WHEN length({key}) = 0 THEN '<unset>' WHEN length({key}) <= 8 THEN repeat('*', length({key})) ELSE substr({key}, 1, 3) || '...' || right({key}, 4) END AS masked FROM documents",
        "provider_parse": f"SELECT doc_id, {provider} AS provider FROM (SELECT doc_id, {pick(LABELS, 'doc_id')} AS c FROM documents)",
        "rate_limit": f"{LIMITED} SELECT ids[i] AS event_id, list_contains(adm, i) AS admitted FROM a, unnest(range(1, len(ids) + 1)) AS u(i)",
        "rate_limit_hot": f"{LIMITED.replace('GROUP BY event_type', '').replace('SELECT event_type, list(event_id', "SELECT 'all' AS event_type, list(event_id")} SELECT ids[i] AS event_id, list_contains(adm, i) AS admitted, CAST(len(list_filter(adm, lambda j: j <= i AND ts[i] - ts[j] <= 21600000000)) AS INTEGER) AS used FROM a, unnest(range(1, len(ids) + 1)) AS u(i)",
        "rate_status": f"{LIMITED}, u AS (SELECT event_type, CAST(len(list_filter(adm, lambda j: ts[len(ts)] - ts[j] <= 21600000000)) AS INTEGER) AS used FROM a) SELECT event_type, used AS requests_used, CAST(15 - used AS INTEGER) AS requests_remaining, used < 15 AS available FROM u",
        "verdict_normalize": f"SELECT event_id, {normal('expected_verdict')} AS label FROM {LABELLED}",
        "verdict_correct": f"SELECT event_id, CASE WHEN expected_verdict <> '' THEN {normal('expected_verdict')} = {normal('actual_verdict')} OR ({normal('expected_verdict')} = 'BLOCKED' AND {normal('actual_verdict')} = 'HIGH_RISK') END AS correct FROM {LABELLED}",
        "eval_metrics": f"SELECT n, has_expected, tp, tn, fp, fn, correct_count, {', '.join(f'round({c}, 9) AS {c}' for c in ('accuracy', 'precision', 'recall', 'f1'))} FROM {evaluated_sql(f'''(SELECT CASE WHEN l.toxic = 1 THEN 'ATTACK' WHEN l.doc_id IS NOT NULL THEN 'benign' END AS expected_verdict, CASE WHEN g.action = 'BLOCK' THEN 'BLOCKED' ELSE 'SAFE' END AS actual_verdict, FALSE AS llm_used, 1.0::DOUBLE AS latency_ms FROM (SELECT doc_id, {action_sql()} FROM {docs}) g LEFT JOIN labels l USING (doc_id))''')}",
        "eval_latency": f"SELECT n, tp, tn, fp, fn, correct_count, llm_used, llm_skipped, {', '.join(f'round({c}, 6) AS {c}' for c in ('avg_latency_ms', 'avg_latency_without_llm', 'avg_latency_with_llm', 'llm_used_share', 'llm_skipped_share', 'accuracy', 'precision', 'recall', 'f1'))} FROM {evaluated_sql(LABELLED)}",
        "prompt_truncate": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS prompt FROM documents",
        "results_rows": f"SELECT text AS prompt, {pick(NAMES, 'k')} AS expected_verdict, verdict AS actual_verdict, risk_score, sure_of AS confidence, FALSE AS llm_used, CASE WHEN {pick(NAMES, 'k')} <> '' THEN {normal(pick(NAMES, 'k'))} = verdict OR ({normal(pick(NAMES, 'k'))} = 'BLOCKED' AND verdict = 'HIGH_RISK') END AS correct FROM {analyzed}",
        "csv_roundtrip": f"SELECT text AS prompt, 'SAFE' AS expected_verdict FROM {prompts}",
    }
    found = f"list_transform(k, lambda x: {kinds}[x.o + 1] || ':' || x.s || ':' || x.e || ':' || sha256(substr(text, x.s + 1, x.e - x.s)) || ':HIGH')"
    audited = f"SELECT sha256(text) AS payload_sha256, {action_sql()}, sha256(redacted) AS redacted_sha256, array_to_string({found}, ',') AS findings, 'SAFE' AS intent_verdict, CAST(0 AS INTEGER) AS risk_score, FALSE AS llm_used FROM {docs}"
    best = lambda own: "(SELECT array_to_string(list_transform(list_sort([" + ", ".join(f"{{'s': -{c}, 'n': {q(n)}}}" for n, c in own.items()) + "])[1:2], lambda e: e.n || '=' || printf('%.3f', -e.s)), ', '))"
    dims, at = {}, 0
    for d, own in P.INTENTS.items():
        dims[d] = {i: f"s{at + n}" for n, i in enumerate(own)}
        at += len(own)
    shown = "CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END"
    safe = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    bar = lambda r: f"CASE WHEN {r} < 40 THEN 'low' WHEN {r} < 70 THEN 'middle' ELSE 'high' END"
    four = [("obfuscation", "o", "CASE WHEN len(techniques) > 0 THEN array_to_string(techniques, ', ') ELSE 'none' END"), ("behaviour", "b", "len(named) || ' found'"), ("semantic", "s", "'0 rules hold'"), ("injection", "0", "CASE WHEN tc > 0.5 THEN 'likely' ELSE 'unlikely' END")]
    items = [f"'<li class=\"' || {bar(r)} || '\">{n} ' || {r} || ': ' || {d} || '</li>'" for n, r, d in four]
    rows4 = [f"chr(10) || '  {n} ' || {r} || ', ' || {d}" for n, r, d in four]
    early_or = lambda x: f"{x[0]} || {x[1]} || CASE WHEN early THEN '' ELSE {x[2]} || {x[3]} END"
    out |= {
        "view_html": f"SELECT {shown} AS prompt, '<article class=\"' || lower(verdict) || '\"><h2>' || verdict || ' ' || risk_score || '</h2><p>' || {safe(shown)} || '</p><ul>' || {early_or(items)} || '</ul></article>' AS html FROM {explained_sql(analyzed)}",
        "view_trace": f"SELECT {shown} AS prompt, verdict || ', risk ' || risk_score || ', confidence ' || sure_of || {early_or(rows4)} AS lines FROM {explained_sql(analyzed)}",
        "metrics_html": f"SELECT '<table>' || string_agg('<tr><th>' || trim(substr(line, 1, 21)) || '</th><td>' || trim(substr(line, 22)) || '</td></tr>', '' ORDER BY i) || '</table>' AS html FROM ({report_sql()})",
        "analyze_explained": f"SELECT CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS prompt, CAST(risk_score AS INTEGER) AS risk_score, report, CASE WHEN early THEN 'skipped' ELSE {fusion_reason_sql()} END AS fusion, CASE WHEN early THEN {q(EARLY)} WHEN {ask} THEN {REASONS} || {q(NO_JUDGE)} ELSE {REASONS} END AS triage, FALSE AS llm_used FROM {explained_sql(analyzed)}",
        "results_sink": f"SELECT sha256(text) AS prompt_sha256, 'SAFE' AS expected_verdict, verdict AS actual_verdict, CAST(risk_score AS VARCHAR) AS risk_score, sure_of AS confidence, 'NO' AS llm_used, '12' AS latency_ms, CASE WHEN verdict = 'SAFE' THEN 'true' ELSE 'false' END AS correct FROM {analyzed_sql('documents')}",
        "audit_sink": audited,
        "stream_audit": audited,
        "findings_json": f"SELECT doc_id, CAST(to_json(list_transform(k, lambda x: {{'dtype': {kinds}[x.o + 1], 'start': x.s, 'end': x.e, 'snippet': substr(text, x.s + 1, x.e - x.s), 'confidence': 'HIGH'}})) AS VARCHAR) AS findings FROM {docs}",
        "metrics_report": report_sql(),
        "sem_top_two": f"{SCORED.replace(', 6), 0)', ', 9), 0)')} SELECT vec_id, " + ", ".join(f"{best(own)} AS {d}" for d, own in dims.items() if len(own) > 1) + " FROM s",
        "fusion_reasons": f"SELECT event_id, {fusion_reason_sql()} AS reason FROM {fused_sql(RISKS)}",
        "stream_screen": f"SELECT doc_id, verdict, {action_sql(block=blocking)} FROM {gated_sql('(SELECT doc_id, text, verdict FROM ' + analyzed_sql('documents') + ')')}",
        "stream_limit": out["rate_limit"],
    }
    return out


SQL = build()
