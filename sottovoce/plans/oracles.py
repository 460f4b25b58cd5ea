"""The SQL of the registered queries, for an engine that reads the same tables."""

from __future__ import annotations

from sottovoce.functions import numbers
from sottovoce.functions.fuzzy import allowed
from sottovoce.functions.numbers import AMBIGUOUS, DIGIT_WORDS, JOINERS, REPEATERS
from sottovoce.operators.keywords import FUZZY_DISCOUNT, FUZZY_MIN, _floor
from sottovoce.sources.policy import SUFFIXES, Policy


def _q(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _folded(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), 'ß', 'ss')"


def _marks(x: str) -> str:
    t = f"replace(replace({x}, '''', ''), '’', '')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[\p{{P}}\p{{S}}\p{{Cc}}]', ' ', 'g'), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+', ' ', 'g'))"


def _severity(x: str) -> str:
    b = Policy.example().bands
    return f"CASE WHEN {x} >= {b['critical']}::DOUBLE THEN 'CRITICAL' WHEN {x} >= {b['high']}::DOUBLE THEN 'HIGH' WHEN {x} >= {b['medium']}::DOUBLE THEN 'MEDIUM' WHEN {x} >= {b['low']}::DOUBLE THEN 'LOW' ELSE 'NONE' END"


def _phrases(policy: Policy | None = None) -> str:
    """Phrases of a policy in Latin letters; their keys are their texts in lower case, all distinct."""
    rows = ", ".join(f"({_text(c)}, {_text(lang)}, {_text(t)}, {w}::DOUBLE)" for c, lang, t, w, _ in (policy or Policy.example()).entries())
    return f"policy(category, lang, phrase, weight) AS (VALUES {rows})"


def _hits(texts: str, policy: Policy | None = None) -> str:
    """CTEs after one named t(id, normal): hits(id, category, phrase, weight, lang)."""
    endings = ", ".join(f"({_text(s)})" for s in ["", *SUFFIXES])
    return f"""{_phrases(policy)},
endings(e) AS (VALUES {endings}),
spelled AS (SELECT *, ' ' || lower(phrase) || e || ' ' AS k FROM policy, endings),
{texts},
hits AS (SELECT DISTINCT id, category, phrase, weight, lang FROM t JOIN spelled ON contains(' ' || normal || ' ', k))"""


def _kept() -> str:
    """After _hits: kept(id, category, phrase, weight), without hits inside others of their category that weigh no less."""
    return """kept AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.id = h.id AND o.category = h.category AND o.phrase <> h.phrase
  AND o.weight >= h.weight AND contains(' ' || lower(o.phrase) || ' ', ' ' || lower(h.phrase) || ' ')))"""


def _common(read: str, width: str, skipped: str = "0") -> str:
    """Length of the longest common subsequence of a text and `width` letters of a phrase, behind those that are skipped, in bits, letter by letter."""
    ones = f"((1::BIGINT << {width}) - 1)"
    return f"""({width} - bit_count(list_reduce(list_prepend({ones}, list_transform(string_split({read}, ''), lambda c: (coalesce(masks[unicode(c) + 1], 0) >> {skipped}) & {ones})), lambda v, b: ((v + (v & b)) | (v - (v & b))) & {ones})))"""


def _similar(policy: Policy) -> str:
    """After _hits: by_sound(id, category, phrase, weight, lang, similarity), phrases by sound that don't stand there exactly, and
    words(id, category, phrase, weight, match, similarity), what is left of both.

    A window that is similar enough holds one of the phrase's disjoint pieces untouched; where one stands, a window wide enough
    for every alignment bounds them all, and those that may pass are measured one by one. Texts shorter than a phrase are held against every window of it."""
    sounds, pieces = [], []
    for c, lang, t, w, _ in policy.entries():
        s = t.lower().replace(" ", "")
        if len(s) < FUZZY_MIN:
            continue
        slack = allowed(len(s), _floor(s))
        masks = ", ".join(str(sum(1 << i for i, y in enumerate(s) if ord(y) == x)) for x in range(128))
        sounds.append(f"({_text(c)}, {_text(lang)}, {_text(t)}, {round(w * FUZZY_DISCOUNT, 4)}::DOUBLE, {_text(s)}, {len(s)}, {_floor(s)}::DOUBLE, {slack}, [{masks}]::BIGINT[])")
        size = len(s) // (slack + 1)
        pieces += [f"({_text(t)}, {_text(s[k * size : (k + 1) * size])}, {k * size}, {size})" for k in range(slack + 1)]
    return f"""sounds(category, lang, phrase, weight, s, n, least, slack, masks) AS (VALUES {', '.join(sounds)}),
pieces(phrase, piece, place, size) AS (VALUES {', '.join(pieces)}),
spoken AS (SELECT id, replace(normal, ' ', '') AS x, length(replace(normal, ' ', '')) AS m FROM t),
letters AS (SELECT id, unnest(string_split(x, '')) AS c, unnest(range(1, m + 1)) AS i FROM spoken WHERE m > 0),
trios AS (SELECT id, i, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS three FROM letters WINDOW w AS (PARTITION BY id ORDER BY i)),
near AS (SELECT DISTINCT id, phrase, i - place AS spot FROM trios JOIN pieces ON three = left(piece, 3)),
wide AS (SELECT id, phrase, spot, greatest(spot - slack, 1) AS lo, least(spot + n - 1 + slack, m) AS hi, x, n, least, slack, masks, spot - slack < 1 OR spot + n - 1 + slack > m AS clipped FROM near JOIN spoken USING (id) JOIN sounds USING (phrase) WHERE m >= n),
hopeful AS (SELECT id, phrase, spot FROM wide WHERE {_common('substr(x, lo, hi - lo + 1)', 'n')} >= ceil(least * (n + CASE WHEN clipped THEN ceil(least * n / (200 - least)) ELSE n END) / 200)),
spans AS (SELECT DISTINCT id, phrase, spot + j AS f FROM hopeful JOIN sounds USING (phrase), range(-20, 21) z(j) WHERE j BETWEEN -slack AND slack),
tried AS (SELECT id, phrase, n, substr(x, greatest(f, 1), least(f + n - 1, m) - greatest(f, 1) + 1) AS read, 0 AS skipped, n AS width FROM spans JOIN spoken USING (id) JOIN sounds USING (phrase) WHERE f <= m AND f + n - 1 >= 1
  UNION ALL SELECT id, phrase, m, x, greatest(f, 1) - 1, least(f + m - 1, n) - greatest(f, 1) + 1 FROM spoken JOIN sounds ON m BETWEEN {FUZZY_MIN} AND n - 1, range(-60, 61) z(f) WHERE f BETWEEN 2 - m AND n),
measured AS (SELECT id, phrase, 200 * {_common('read', 'width', 'skipped')} / (CASE WHEN tried.n < sounds.n THEN tried.n + width ELSE sounds.n + length(read) END)::DOUBLE AS ratio, least FROM tried JOIN sounds USING (phrase)),
alike AS (SELECT id, phrase, max(ratio) AS ratio FROM measured WHERE ratio >= least GROUP BY id, phrase),
by_sound AS (SELECT id, category, phrase, weight, lang, round(ratio, 1) AS similarity FROM alike JOIN sounds USING (phrase) WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.id = alike.id AND hits.phrase = alike.phrase)),
both_ways AS (SELECT id, category, phrase, weight, 'exact' AS match, NULL::DOUBLE AS similarity FROM hits
  UNION ALL SELECT id, category, phrase, weight, 'fuzzy', similarity FROM by_sound f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.id = f.id AND h.category = f.category AND h.weight >= f.weight)),
words AS (SELECT * FROM both_ways h WHERE NOT EXISTS (SELECT 1 FROM both_ways o WHERE o.id = h.id AND o.category = h.category AND o.phrase <> h.phrase
  AND o.weight >= h.weight AND contains(' ' || lower(o.phrase) || ' ', ' ' || lower(h.phrase) || ' ')))"""


def _runs(texts: str) -> str:
    """CTEs after one named t(id, folded): runs(id, run) of three digits at least."""
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    ipv4 = rf"\b{octet}(?:\.{octet}){{3}}\b"
    digits = ", ".join(f"({_text(w)}, {_text(d)})" for w, d in DIGIT_WORDS.items())
    repeaters = ", ".join(f"({_text(w)}, {n})" for w, n in REPEATERS.items())
    listed = lambda ws: ", ".join(_text(w) for w in ws)
    residual = f"replace(regexp_replace(regexp_replace(folded, '{ipv4}', ' ', 'g'), '{_IBAN}', ' ', 'g'), '.', ' dot ')"
    return f"""{texts},
digit_words(w, d) AS (VALUES {digits}), repeaters(w, times) AS (VALUES {repeaters}),
toks AS (SELECT id, string_split({_marks(residual)}, ' ') AS ws FROM t),
tok AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM toks),
typed AS (SELECT tok.id, i, tok.w, CASE WHEN regexp_full_match(tok.w, '[0-9]+') THEN tok.w ELSE d END AS d, times, tok.w IN ({listed(JOINERS)}) AS joins,
  tok.w NOT IN ({listed(AMBIGUOUS)}) AS sure FROM tok LEFT JOIN digit_words dw ON dw.w = tok.w LEFT JOIN repeaters r ON r.w = tok.w),
cut AS (SELECT *, sum(CASE WHEN d IS NULL AND times IS NULL AND NOT joins THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS stretch,
  lag(times) OVER (PARTITION BY id ORDER BY i) AS before FROM typed),
parts AS (SELECT id, stretch, i, sure, repeat(d, CASE WHEN length(w) > 1 AND regexp_full_match(w, '[0-9]+') THEN 1 ELSE coalesce(before, 1) END) AS part FROM cut WHERE d IS NOT NULL),
runs AS (SELECT id, string_agg(part, '' ORDER BY i) AS run FROM parts GROUP BY id, stretch HAVING bool_or(sure) AND length(string_agg(part, '' ORDER BY i)) >= 3)"""


def _numbered() -> str:
    """After _runs: kinds(id, run, luhn_ok, kind) of distinct runs of seven digits at least."""
    return f"""long_runs AS (SELECT DISTINCT id, run FROM runs WHERE length(run) >= {numbers.MIN_RUN}),
digits_of AS (SELECT id, run, unnest(range(1, length(run) + 1)) AS k FROM long_runs),
weights AS (SELECT id, run, sum(CASE WHEN (length(run) - k) % 2 = 0 THEN CAST(substr(run, k, 1) AS INT)
  ELSE (CAST(substr(run, k, 1) AS INT) * 2) % 10 + CAST(substr(run, k, 1) AS INT) * 2 // 10 END) % 10 = 0 AS luhn_ok FROM digits_of GROUP BY id, run),
kinds AS (SELECT id, run, luhn_ok, CASE WHEN length(run) = 13 THEN 'cnic' WHEN length(run) BETWEEN 13 AND 19 AND luhn_ok THEN 'payment_card'
  WHEN (length(run) = 11 AND starts_with(run, '03')) OR (length(run) = 12 AND starts_with(run, '923')) THEN 'phone' WHEN length(run) >= 9 THEN 'long_number'
  WHEN starts_with(run, '0') THEN 'phone' END AS kind FROM weights)"""


def _mask(x: str) -> str:
    return f"CASE WHEN length({x}) <= 6 THEN repeat('*', length({x})) ELSE left({x}, 3) || repeat('*', length({x}) - 6) || right({x}, 3) END"


_IBAN = r"\b[a-z]{2}\d{2}(?:\s?[a-z0-9]{4}){2,7}(?:\s?[a-z0-9]{1,4})?\b"
_IPV4 = r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"


def _verdict(documents: str | None = None) -> str:
    """Of the documents, or of a query that stands for them: WITH ... v(doc_id, lang, source, keyword_score, pattern_score, threat_score, severity, is_violation, n_matches, categories, sources)."""
    rules = Policy.example().rules
    weights = ", ".join(f"({_text(k)}, {w}::DOUBLE, {_text(label)})" for k, (w, label) in rules.items())
    t = f"docs AS (SELECT doc_id AS id, {_folded('text')} AS folded FROM documents), t AS (SELECT id, folded, {_marks('folded')} AS normal FROM docs)"
    given = f"documents AS ({documents}), " if documents else ""
    return f"""WITH {given}{_hits(t)}, {_similar(Policy.example())},
{_runs("u AS (SELECT 1)")}, {_numbered()},
rules(kind, weight, label) AS (VALUES {weights}),
quads AS (SELECT id, unnest(list_distinct(regexp_extract_all(folded, '{_IPV4}'))) AS v FROM t),
found AS (SELECT id, kind, {_mask('run')} AS shown FROM kinds WHERE kind IS NOT NULL
  UNION ALL SELECT id, 'ipv4', regexp_replace(v, '\\.[0-9]+$', '.*') FROM quads),
numbered AS (SELECT DISTINCT id, 'sensitive_pattern' AS category, label || ': ' || shown AS phrase, weight FROM found JOIN rules USING (kind)),
ms AS (SELECT id, category, phrase, weight, match FROM words UNION ALL SELECT id, category, phrase, weight, 'pattern' FROM numbered),
sums AS (SELECT id, max(weight) FILTER (match <> 'pattern') AS kw, max(weight) FILTER (match = 'pattern') AS pat, bool_or(match = 'exact') AS exact, bool_or(match = 'fuzzy') AS fuzzy, count(*) AS n, string_agg(DISTINCT category, '|' ORDER BY category) AS cats FROM ms GROUP BY id),
scored AS (SELECT d.doc_id, d.lang, d.source, coalesce(kw, 0.0)::DOUBLE AS kw, coalesce(pat, 0.0)::DOUBLE AS pat, exact, fuzzy, coalesce(n, 0) AS n, coalesce(cats, '') AS cats FROM documents d LEFT JOIN sums ON sums.id = d.doc_id),
fused AS (SELECT *, {_q('1.0::DOUBLE - (1.0::DOUBLE - kw) * (1.0::DOUBLE - 0.7::DOUBLE * 0.0::DOUBLE) * (1.0::DOUBLE - 1.0::DOUBLE * pat)')} AS score FROM scored),
v AS (SELECT doc_id, lang, source, {_q('kw')} AS keyword_score, {_q('pat')} AS pattern_score, score AS threat_score, {_severity('score')} AS severity, {_severity('score')} IN ('HIGH', 'CRITICAL') AS is_violation, CAST(n AS BIGINT) AS n_matches, cats AS categories,
  concat_ws('|', CASE WHEN exact THEN 'keyword' END, CASE WHEN fuzzy THEN 'phonetic' END, CASE WHEN pat > 0 THEN 'pattern' END) AS sources FROM fused)"""


_NORMAL = f"docs AS (SELECT doc_id AS id, {_folded('text')} AS folded FROM documents), t AS (SELECT id, {_marks('folded')} AS normal FROM docs)"
_FOLDED = f"t AS (SELECT doc_id AS id, {_folded('text')} AS folded FROM documents)"
_ALERTS = f"""alerts AS (SELECT event_id AS id, ts, user_id AS endpoint_id, event_type AS category, value, {_severity("((value % 100.0::DOUBLE) / 100.0::DOUBLE)")} AS severity,
  CASE WHEN event_id % 7 <> 0 THEN event_id % 5000 END AS latency_ms FROM events)"""
_UNIT = """raw AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM raw GROUP BY vec_id), unit AS (SELECT raw.vec_id, i, x / greatest(n, 1e-9::DOUBLE) AS x FROM raw JOIN norms USING (vec_id))"""
_SIMS = _UNIT + """, sims AS (SELECT a.vec_id, b.vec_id AS idx, sum(a.x * b.x) AS sim FROM unit a JOIN unit b ON a.i = b.i AND b.vec_id BETWEEN 0 AND 35 GROUP BY a.vec_id, b.vec_id)"""
_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
_OUTBOX = f"""{_ALERTS}, box AS (SELECT id, ts, id % 3 <> 0 AS tried, id % 2 = 0 AS ok FROM alerts WHERE severity IN ('HIGH', 'CRITICAL')),
state AS (SELECT id, CASE WHEN tried AND NOT ok THEN 1 ELSE 0 END AS attempts, CASE WHEN tried AND NOT ok THEN ts + INTERVAL 5 SECOND ELSE ts END AS next_attempt,
  tried AND ok AS delivered, CASE WHEN tried AND NOT ok THEN 'failed ' || id END AS last_error FROM box)"""


_ACCOUNT = """text || CASE WHEN doc_id % 10 = 0 THEN format(' Pay to DE{:02d} 3704 0044 0532 {:04d} 00, or gb{:02d}west1234569876{:04d}.', doc_id % 90 + 10, doc_id % 10000, doc_id % 80 + 11, doc_id % 10000) ELSE '' END"""
_ENTRIES = f"""e AS (SELECT 'topic ' || (item_id % 4) AS category, CASE WHEN item_id % 3 = 0 THEN 'fr' ELSE 'en' END AS lang, array_to_string(string_split(text, ' ')[1:2], ' ') AS text, (item_id % 7 + 1) / 8.0::DOUBLE AS weight, item_id FROM benchmark),
k AS (SELECT *, {_marks(_folded('text'))} AS key FROM e), policy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, item_id) AS r FROM k WHERE key <> '') WHERE r = 1)"""
_TREES = """RECURSIVE o AS (SELECT o_orderkey AS id, o_orderkey // 1000 AS batch, epoch_us(o_orderdate) AS us, o_orderstatus AS s, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS pos FROM orders),
leaf AS (SELECT batch, pos, sha256('leaf|alert|' || id || '|' || us || '|' || sha256(length(CAST(id AS VARCHAR)) || ':' || id || ',' || length(p) || ':' || p || ',' || length(s) || ':' || s) || '|') AS h, count(*) OVER (PARTITION BY batch) AS n FROM o),
tree(batch, lev, pos, h, width) AS (SELECT batch, CAST(0 AS BIGINT), pos, h, n FROM leaf UNION ALL
  SELECT batch, min(lev) + 1, pos // 16, sha256('node|' || string_agg(h, ',' ORDER BY pos)), (min(width) + 15) // 16 FROM tree WHERE width > 1 GROUP BY batch, pos // 16),
roots AS (SELECT tree.batch, h AS root, l.n FROM tree JOIN (SELECT batch, count(*) AS n FROM leaf GROUP BY batch) l ON l.batch = tree.batch WHERE width = 1)"""


def sql(spoken: Policy) -> dict[str, str]:
    """spoken: the policy of phrase_hits_fuzzy."""
    return {
        "norm_text": f"WITH {_NORMAL} SELECT id AS doc_id, sha256(normal) AS normal_sha256, CAST(length(normal) AS BIGINT) AS n_chars FROM t",
        "norm_text_unicode": f"WITH {_NORMAL} SELECT id AS doc_id, normal, replace(normal, ' ', '') AS skeleton FROM t",
        "second_opinion_upgrade": f"""WITH edge AS (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS z FROM conversations GROUP BY conv_id),
one AS ({_verdict("SELECT conv_id AS doc_id, a || ' token' AS text, NULL AS lang, NULL AS source FROM edge")} SELECT * FROM v),
two AS ({_verdict("SELECT conv_id AS doc_id, z || CASE WHEN length(z) % 2 = 0 THEN ' access token' ELSE '' END AS text, NULL AS lang, NULL AS source FROM edge")} SELECT * FROM v),
ranks(severity, r) AS (VALUES ('NONE', 0), ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4))
SELECT one.doc_id AS conv_id, one.severity AS severity_before, two.severity AS severity_after, two.threat_score FROM one JOIN two ON two.doc_id = one.doc_id JOIN ranks a ON a.severity = one.severity JOIN ranks b ON b.severity = two.severity
WHERE one.severity <> 'CRITICAL' AND (one.threat_score >= 0.2 OR one.n_matches > 0) AND b.r > a.r AND two.is_violation""",
        "script_profile": r"SELECT doc_id, CASE WHEN regexp_matches(text, '\p{L}') THEN 'latin' ELSE 'none' END AS script, FALSE AS is_rtl FROM documents",
        "phrase_hits_exact": f"WITH {_hits(_NORMAL)} SELECT id AS doc_id, category, phrase, weight, lang FROM hits",
        "phrase_hits_ranked": f"WITH {_hits(_NORMAL)}, {_kept()} SELECT id AS doc_id, count(*) AS n_matches, max(weight) AS score, string_agg(phrase, '|' ORDER BY phrase) AS phrases FROM kept GROUP BY id",
        "phrase_hits_fuzzy": f"""WITH {_hits(f"docs AS (SELECT conv_id || '-' || turn AS id, {_folded('text')} AS folded FROM conversations), t AS (SELECT id, {_marks('folded')} AS normal FROM docs)", spoken)}, {_similar(spoken)}
SELECT id, category, phrase, weight, match, similarity FROM words""",
        "ipv4_hits": f"SELECT doc_id, unnest(list_distinct(regexp_extract_all({_folded('text')}, '{_IPV4}'))) AS ip FROM documents",
        "iban_hits": f"SELECT doc_id, iban, {_mask('upper(iban)')} AS masked FROM (SELECT DISTINCT doc_id, replace(v, ' ', '') AS iban FROM (SELECT doc_id, unnest(regexp_extract_all({_folded(_ACCOUNT)}, '{_IBAN}')) AS v FROM documents)) WHERE length(iban) BETWEEN 15 AND 34 AND length(regexp_replace(iban, '[^0-9]', '', 'g')) >= 10",
        "digit_runs_classified": f"WITH {_runs(_FOLDED)}, {_numbered()} SELECT id AS doc_id, run, kind, luhn_ok FROM kinds",
        "masked_values": f"WITH {_runs(_FOLDED)} SELECT id AS doc_id, {_mask('run')} AS masked, CAST(length(run) AS BIGINT) AS n FROM (SELECT DISTINCT id, run FROM runs)",
        "verdict_fused": f"{_verdict()} SELECT doc_id, keyword_score, pattern_score, threat_score, severity, is_violation, n_matches, categories, sources FROM v",
        "severity_counts": f"{_verdict()} SELECT severity, count(*) AS n FROM v GROUP BY severity",
        "language_counts": f"{_verdict()} SELECT coalesce(lang, 'unknown') AS language, count(*) AS n FROM v WHERE severity <> 'NONE' GROUP BY 1",
        "category_counts": f"{_verdict()} SELECT category, count(DISTINCT id) AS n FROM ms GROUP BY category",
        "alert_page": f"WITH {_ALERTS} SELECT id, severity, endpoint_id, category FROM alerts WHERE severity = 'HIGH' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 10",
        "alert_stats": f"WITH {_ALERTS} SELECT count(*) AS total, count(*) FILTER (ts >= {_AS_OF} - INTERVAL 24 HOUR) AS last_24h, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms, max(latency_ms) AS max_latency_ms FROM alerts",
        "nearest_reference": f"WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, idx) AS k FROM sims WHERE idx <= 22) SELECT vec_id, CAST(idx AS INT) AS idx, {_q('sim')} AS similarity FROM r WHERE k = 1",
        "semantic_margin": f"WITH {_SIMS}, m AS (SELECT vec_id, max(CASE WHEN idx <= 22 THEN sim END) - max(CASE WHEN idx > 22 THEN sim END) AS m FROM sims GROUP BY vec_id) SELECT vec_id, {_q('m')} AS margin, {_q('greatest(least((m - 0.04::DOUBLE) / (0.3::DOUBLE - 0.04::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE)')} AS score FROM m",
        "repeat_escalation": f"""WITH {_ALERTS}, a AS (SELECT * FROM alerts WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL')),
c AS (SELECT id, severity, count(*) OVER (PARTITION BY endpoint_id, category ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1
  - (count(*) OVER (PARTITION BY endpoint_id, category, ts) - row_number() OVER (PARTITION BY endpoint_id, category, ts ORDER BY id)) AS repeats FROM a)
SELECT id, repeats, CASE WHEN repeats < 2 THEN severity WHEN severity = 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM c""",
        "segments_sessionised": """WITH m AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS segment FROM m)
SELECT user_id AS endpoint_id, CAST(segment AS BIGINT) AS segment, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS stop_us, count(*) AS chunks FROM s GROUP BY user_id, segment""",
        "phrase_confirmation": """WITH e AS (SELECT DISTINCT user_id, event_type, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS w FROM events),
p AS (SELECT *, lag(w) OVER (PARTITION BY user_id, event_type ORDER BY w) AS b FROM e), q AS (SELECT *, lag(b) OVER (PARTITION BY user_id, event_type ORDER BY w) AS bb FROM p)
SELECT user_id, event_type, min(w) AS confirmed_at FROM q WHERE w - b = 1 GROUP BY user_id, event_type""",
        "muted_runs": """WITH a AS (SELECT user_id, event_id, value <= 30.0 AS q FROM events), b AS (SELECT *, CASE WHEN q = lag(q) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS turn FROM a),
c AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM b WHERE TRUE)
SELECT user_id, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM c WHERE q GROUP BY user_id, run HAVING count(*) >= 3""",
        "raised_level": """SELECT event_id, floor(10.0::DOUBLE * log10(avg(power(10.0::DOUBLE, -(value % 60.0::DOUBLE) / 10.0::DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) * 100 + 0.5) / 100 AS mean_db FROM events""",
        "level_db": f"""WITH raw AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT vec_id, sum(x * x) / count(*) AS p, max(abs(x)) AS peak FROM raw GROUP BY vec_id)
SELECT vec_id, {_q('greatest(20.0::DOUBLE * log10(sqrt(p) + 1e-12::DOUBLE), -90.0::DOUBLE)')} AS db, {_q('peak')} AS peak FROM s""",
        "chain_build": """WITH RECURSIVE o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS us, o_orderstatus AS s, o_orderpriority AS p, o_custkey AS endpoint, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders),
h AS (SELECT endpoint, seq, id, us, sha256(length(CAST(id AS VARCHAR)) || ':' || id || ',' || length(p) || ':' || p || ',' || length(s) || ':' || s) AS payload FROM o),
c(endpoint, seq, ref_id, row_hash) AS (SELECT DISTINCT endpoint, CAST(0 AS BIGINT), CAST(0 AS BIGINT), repeat('0', 64) FROM h UNION ALL
  SELECT h.endpoint, h.seq, h.id, sha256(c.row_hash || '|alert|' || h.id || '|' || h.us || '|' || h.payload || '|') FROM c JOIN h ON h.endpoint = c.endpoint AND h.seq = c.seq + 1)
SELECT endpoint, seq, ref_id, row_hash FROM c WHERE seq > 0""",
        "chain_tamper_detect": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS endpoint, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders)
SELECT endpoint, seq, CASE WHEN id % 12 = 0 THEN 'missing row' ELSE 'edited row' END AS problem FROM o WHERE id % 12 = 0 OR id % 8 = 0""",
        "retention_purge": f"WITH {_ALERTS} SELECT category, count(*) AS n, CASE WHEN ts >= {_AS_OF} - INTERVAL 20 DAY THEN 'kept' ELSE 'expired' END AS state FROM alerts GROUP BY category, state",
        "transcript_minimised": "SELECT conv_id, turn, substr(sha256(coalesce(text, '')), 1, 16) AS transcript_hash, CAST(NULL AS VARCHAR) AS text FROM conversations",
        "outbox_due": f"WITH {_OUTBOX} SELECT id, CAST(attempts AS BIGINT) AS attempts FROM state WHERE NOT delivered AND next_attempt <= {_AS_OF} ORDER BY id LIMIT 20",
        "outbox_stats": f"WITH {_OUTBOX} SELECT count(*) FILTER (NOT delivered) AS pending, count(*) FILTER (delivered) AS delivered, arg_max(last_error, id) FILTER (last_error IS NOT NULL) AS last_error FROM state",
        "policy_summary": f"WITH {_ENTRIES} SELECT count(*) AS phrases, count(DISTINCT category) AS categories, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM policy",
        "policy_report": f"WITH {_ENTRIES} SELECT category, lang, count(*) AS phrases, max(weight) AS max_weight, string_agg(text, '|' ORDER BY text) AS texts FROM policy GROUP BY category, lang",
        "detector_quality": f"{_verdict()} SELECT l.toxic, contains(v.categories, 'safety_threats') AS hit, count(*) AS n FROM v JOIN labels l ON l.doc_id = v.doc_id GROUP BY 1, 2",
        "noise_floor": f"""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, {_q("sum(value * power(0.99::DOUBLE, n - i) * CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END)")} AS "floor" FROM s GROUP BY user_id""",
        "spotting_windows": """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
c AS (SELECT user_id, n // 375 AS segment, n % 375 + 1 AS pos FROM r WHERE value >= 20),
w(user_id, segment, window_idx, stop) AS (SELECT user_id, segment, CAST(0 AS BIGINT), min(pos) FROM c WHERE pos >= 20 GROUP BY user_id, segment
  UNION ALL SELECT c.user_id, c.segment, max(w.window_idx) + 1, min(c.pos) FROM w JOIN c ON c.user_id = w.user_id AND c.segment = w.segment AND c.pos >= w.stop + 5 GROUP BY c.user_id, c.segment)
SELECT user_id, CAST(segment AS BIGINT) AS segment, window_idx, CAST(stop - 20 AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM w""",
        "early_warnings": f"""WITH {_hits(_NORMAL)}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, phrase, category) AS r FROM hits)
SELECT id AS doc_id, category, phrase, {_severity("weight")} AS estimated_severity FROM k WHERE r = 1""",
        "session_language": "SELECT source, arg_max(lang, CASE WHEN lang IS NOT NULL AND doc_id % 10 >= 6 THEN doc_id END) AS session_language FROM documents GROUP BY source",
        "session_metrics": """WITH e AS (SELECT user_id, ts, event_id AS k, event_id % 9 AS t, CASE WHEN event_id % 9 = 1 THEN (epoch_us(ts) % 5000000) // 1000 END AS ms FROM events)
SELECT user_id, count(*) FILTER (t = 0) AS segments, count(*) FILTER (t = 1) AS transcribed, count(*) FILTER (t = 2) AS discarded_segments, count(*) FILTER (t = 1 AND k % 4 <> 0) AS alerts, count(*) FILTER (t = 3) AS early_warnings,
  count(*) FILTER (t = 4) AS verifications, count(*) FILTER (t = 4 AND k % 2 = 0) AS verify_upgrades, count(*) FILTER (t = 5) AS verify_skipped, count(*) FILTER (t = 6) AS dropped_chunks, count(*) FILTER (t = 7) AS input_overflows,
  count(*) FILTER (t = 8) AS environment_events, round(sum(k % 40 / 4.0::DOUBLE), 2) AS asr_seconds_total, arg_max(ms, ts) FILTER (ms IS NOT NULL) AS last_latency_ms, max(ms) AS max_latency_ms FROM e GROUP BY user_id""",
        "translated_verdicts": f"""{_verdict()}, a AS (SELECT v.doc_id, v.severity, v.severity <> 'CRITICAL' AND v.doc_id % 3 = 0 AND d.text IS NOT NULL AS translated FROM v JOIN documents d ON d.doc_id = v.doc_id)
SELECT doc_id, CASE WHEN translated THEN 'CRITICAL' ELSE severity END AS severity, translated FROM a""",
        "level_telemetry": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) WHERE n % 7 = 0",
        "noise_profile": f"""SELECT event_id, count(*) OVER w AS profile_n, CASE WHEN count(*) OVER w >= 15 THEN {_q("sum(value) OVER w")} END AS profile_power FROM events WHERE value <= 50
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 45 PRECEDING AND CURRENT ROW)""",
        "merkle_chain": f"""WITH {_TREES}, k AS (SELECT *, row_number() OVER (ORDER BY batch) AS seq FROM roots),
c(seq, batch, n, root, row_hash) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', repeat('0', 64) UNION ALL
  SELECT k.seq, k.batch, k.n, k.root, sha256(c.row_hash || '|batch|' || k.batch || '|' || k.n || '|' || k.root) FROM c JOIN k ON k.seq = c.seq + 1)
SELECT seq, batch, n, root, row_hash FROM c WHERE seq > 0""",
        "merkle_tamper": """SELECT batch, CAST(0 AS INT) AS "level", pos, CASE WHEN id % 12 = 0 THEN 'missing entry' ELSE 'edited entry' END AS problem
FROM (SELECT o_orderkey AS id, o_orderkey // 1000 AS batch, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE id % 12 = 0 OR id % 8 = 0""",
        "merkle_proofs": f"""WITH {_TREES}, up AS (SELECT l.batch, l.pos, t.lev, string_agg(CASE WHEN t.pos = l.pos // (16 ** t.lev)::BIGINT THEN '-' ELSE t.h END, ',' ORDER BY t.pos) AS x
  FROM leaf l JOIN tree t ON t.batch = l.batch AND t.width > 1 AND t.pos // 16 = l.pos // (16 ** (t.lev + 1))::BIGINT GROUP BY l.batch, l.pos, t.lev),
p AS (SELECT batch, pos, count(*) AS steps, string_agg(x, ';' ORDER BY lev) AS x FROM up GROUP BY batch, pos)
SELECT l.batch, l.pos, CAST(coalesce(p.steps, 0) AS BIGINT) AS steps, r.root, sha256(coalesce(p.x, '')) AS proof_sha256 FROM leaf l JOIN roots r ON r.batch = l.batch LEFT JOIN p ON p.batch = l.batch AND p.pos = l.pos""",
        "chunk_baselines": f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, -(value % 90.0::DOUBLE) AS x, event_id % 3 = 0 AS speech, event_id % 7 = 0 AS inside FROM events),
f(user_id, n, fl, sp) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM e UNION ALL
  SELECT e.user_id, e.n, CASE WHEN x <= -80 THEN fl WHEN fl IS NULL THEN x WHEN speech OR inside OR (x - fl >= 18 AND x >= -30) THEN fl ELSE fl + 0.01::DOUBLE * (x - fl) END,
    CASE WHEN x <= -80 OR fl IS NULL OR NOT speech THEN sp WHEN sp IS NULL THEN x ELSE sp + 0.02::DOUBLE * (x - sp) END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, n AS chunk_idx, {_q("fl")} AS floor_db, {_q("sp")} AS speaking_db FROM f WHERE n > 0""",
        "spectral_centroid": f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i, len(embedding) AS n FROM embeddings),
w AS (SELECT vec_id, i, n, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / (n - 1))) AS v FROM x),
m AS (SELECT vec_id, k, any_value(n) AS n, sqrt(power(sum(v * cos(2 * pi() * k * i / n)), 2) + power(sum(v * sin(2 * pi() * k * i / n)), 2)) AS mag FROM w, range(0, 33) z(k) WHERE k <= n // 2 GROUP BY vec_id, k)
SELECT vec_id, {_q("sum(mag * k * 16000.0::DOUBLE / n) / greatest(sum(mag), 1e-12::DOUBLE)")} AS centroid FROM m GROUP BY vec_id""",
        "event_cooldown": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c(user_id, n, us) AS (SELECT user_id, n, us FROM e WHERE n = 1 UNION ALL SELECT e.user_id, min(e.n), min(e.us) FROM c JOIN e ON e.user_id = c.user_id AND e.us >= c.us + 21600000000 GROUP BY e.user_id)
SELECT e.user_id, e.event_id FROM e JOIN c ON c.user_id = e.user_id AND c.n = e.n""",
        "segments_forced": """WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, value >= 30 AS speech FROM events),
k AS (SELECT user_id, n + n // 10 * 2 AS i, speech FROM r), b AS (SELECT user_id, min(i) AS begins, max(i) AS ends FROM k GROUP BY user_id),
d AS (SELECT b.user_id, z.i, begins, ends, coalesce(k.speech, FALSE) AS speech FROM b, LATERAL (SELECT unnest(range(begins, ends + 1)) AS i) z LEFT JOIN k ON k.user_id = b.user_id AND k.i = z.i),
f(user_id, i, start, spoken, silent, free, first, stop, speech) AS (SELECT user_id, begins - 1, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), begins, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM b UNION ALL
  SELECT user_id, i, CASE WHEN closed THEN -1 ELSE st END, sp, si, CASE WHEN closed THEN i + 1 ELSE free END, CASE WHEN told THEN st END, CASE WHEN told THEN i + 1 - greatest(si - 6, 0) END, CASE WHEN told THEN sp END FROM (
    SELECT *, st >= 0 AND (closed OR i = ends) AND sp >= 3 AS told FROM (SELECT *, st >= 0 AND (si >= 8 OR i + 1 - st >= 20) AS closed FROM (
      SELECT f.user_id, d.i, d.ends, f.free, CASE WHEN f.start >= 0 THEN f.start WHEN d.speech THEN greatest(d.i - 3, f.free) ELSE -1 END AS st,
        CASE WHEN f.start < 0 THEN CAST(d.speech AS BIGINT) ELSE f.spoken + CAST(d.speech AS BIGINT) END AS sp, CASE WHEN d.speech OR f.start < 0 THEN 0 ELSE f.silent + 1 END AS si
      FROM f JOIN d ON d.user_id = f.user_id AND d.i = f.i + 1))))
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS BIGINT) AS segment_id, first, stop, speech FROM f WHERE first IS NOT NULL""",
        "joint_escalation": f"""WITH {_ALERTS}, a AS (SELECT id, ts, endpoint_id, severity, (value % 100.0::DOUBLE) / 100.0::DOUBLE AS score, CASE WHEN id % 11 <> 0 THEN [category, 'group ' || (id % 3)] ELSE [] END AS cats FROM alerts),
e AS (SELECT id, ts, endpoint_id, unnest(cats) AS c FROM a WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL')),
n AS (SELECT x.id, x.c, count(y.id) AS n FROM e x LEFT JOIN e y ON y.endpoint_id = x.endpoint_id AND y.c = x.c AND (y.ts < x.ts OR (y.ts = x.ts AND y.id < x.id)) AND epoch_us(x.ts) - epoch_us(y.ts) <= 86400000000 GROUP BY x.id, x.c),
m AS (SELECT a.id, severity, score, coalesce(max(n), 0) AS repeats FROM a LEFT JOIN n ON n.id = a.id GROUP BY a.id, severity, score),
u AS (SELECT *, CASE WHEN repeats < 2 THEN severity WHEN severity = 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END AS after FROM m)
SELECT id, CAST(repeats AS BIGINT) AS repeats, after AS severity, {_q("CASE WHEN after = severity THEN score ELSE greatest(score, CASE after WHEN 'HIGH' THEN 0.65::DOUBLE ELSE 0.85::DOUBLE END) END")} AS score FROM u""",
        "text_filter": "SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')",
        "csv_projection": f"{_verdict()} SELECT doc_id AS id, '2024-01-01T00:00:00' AS ts, 'upload' AS source, source AS endpoint_id, lang AS language, severity, threat_score, keyword_score, 0.0::DOUBLE AS semantic_score, pattern_score, categories, '' AS transcript, '' AS translation FROM v",
    }
