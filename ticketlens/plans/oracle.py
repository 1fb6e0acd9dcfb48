"""Independent SQL for the query catalog, in the dialect of DuckDB.

The SQL takes other roads than the operators: words and mentions are unnested and joined, context comes from
window functions, pairs from self-joins.
"""

from __future__ import annotations

import re

from ticketlens.functions.wordlists import (
    EMOTICONS, PHRASE_BOOSTS, PHRASE_NEGATIONS, PHRASE_VALENCES, PHRASES_WITHOUT_EFFECT,
    BOOSTERS_DOWN, BOOSTERS_UP, COMPLAINT_KEYWORDS, CRITICAL_ENTITY_WORDS, CRITICAL_PRIORITIES, FLAG_REASONS, LEXICON,
    NEGATIONS, STOP_WORDS,
)
from ticketlens.operators import report as rp
from ticketlens.sources.sample import CATEGORIES, CHANNELS, DEVICES, MOMENTS, PRIORITIES, SCREENS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _bounds(expr: str, choices) -> str:
    whens = " ".join(f"WHEN {expr} < {bound} THEN {_q(value)}" for value, bound in choices)
    return f"CASE {whens} END"


_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_WS = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean(x: str) -> str:
    return _collapse(f"regexp_replace(coalesce({x}, ''), '{_CONTROL}', '', 'g')")


def _mean(x: str, digits: int = 4) -> str:
    return f"round({x} + sign({x}) * 1e-{digits + 5}, {digits})"


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN '0.0%' ELSE printf('%.1f%%', round({part} / nullif({whole}, 0) * 100, 1)) END"


_SLOTS = {
    "order": "'ORD-' || lpad(k, CAST(greatest(6, length(k)) AS INTEGER), '0')",
    "amount": "CAST(amount // 100 AS VARCHAR) || '.' || lpad(CAST(amount % 100 AS VARCHAR), 2, '0')",
    "date": "strftime(o_orderdate, '%Y-%m-%d')",
    "days": "CAST(o_orderkey % 29 + 2 AS VARCHAR)",
    "person": "coalesce(c_name, 'your agent')",
    "product": "coalesce(p_name, 'item')",
    "org": "coalesce(s_name, 'your shop')",
    "place": "coalesce(n_name, 'my city')",
    "screen": f"{_list(SCREENS)}[turn % {len(SCREENS)} + 1]",
    "device": f"{_list(DEVICES)}[turn % {len(DEVICES)} + 1]",
    "moment": f"{_list(MOMENTS)}[(turn // 3) % {len(MOMENTS)} + 1]",
}
_text = f"{_list([t for _, _, texts in CATEGORIES for t in texts])}[cat * 8 + turn % 8 + 1]"
for _name, _sql in _SLOTS.items():
    _text = f"replace({_text}, '{{{_name}}}', {_sql})"

_cat = "CASE " + " ".join(f"WHEN o_orderkey % 20 < {b} THEN {i}" for i, (_, b, _t) in enumerate(CATEGORIES)) + " END"

# name -> (names it reads, sql)
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, *reads: str) -> None:
    CTE[name] = (reads, sql)


_cte("base", f"""
  SELECT o.*, CAST(o.o_orderkey AS VARCHAR) AS k, o.o_orderkey // 20 AS turn, {_cat} AS cat,
         CAST(round(o.o_totalprice * 100) AS BIGINT) % 49001 + 999 AS amount, c.c_name, p.p_name, s.s_name, n.n_name
  FROM orders o
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN part p ON p.p_partkey = o.o_custkey
  LEFT JOIN supplier s ON s.s_suppkey = o.o_custkey // 16
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
_cte("tickets", f"""
  SELECT 'TKT-' || lpad(k, CAST(greatest(8, length(k)) AS INTEGER), '0') AS ticket_id, {_text} AS text,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created_at,
         {_bounds('(o_orderkey // 11) % 20', PRIORITIES)} AS priority,
         {_bounds('(o_orderkey // 7) % 20', CHANNELS)} AS channel,
         {_list([c for c, _, _ in CATEGORIES])}[cat + 1] AS category
  FROM base""", "base")
_cte("messy", """
  SELECT ticket_id, created_at, n, CASE n % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN ' x '
           WHEN 4 THEN chr(9) || text || chr(10) || chr(10) WHEN 5 THEN replace(text, ' ', chr(160) || ' ')
           WHEN 6 THEN chr(1) || text || chr(127) WHEN 7 THEN ' ab' ELSE text END AS text
  FROM (SELECT *, CAST(substr(ticket_id, 5) AS BIGINT) AS n FROM tickets)""", "tickets")
_cte("lex", "SELECT * FROM (VALUES " + ", ".join(f"({_q(w)}, {v}::DOUBLE)" for w, v in LEXICON.items()) + ") AS l(token, valence)")
_cte("boost", "SELECT * FROM (VALUES " + ", ".join(
    [f"({_q(w)}, 0.293::DOUBLE)" for w in BOOSTERS_UP] + [f"({_q(w)}, -0.293::DOUBLE)" for w in BOOSTERS_DOWN]) + ") AS b(word, amount)")


def _sentiment(prefix: str, source: str, lex: str = "lex", boost: str = "boost", negations: tuple[str, ...] = NEGATIONS) -> None:
    """Scores for a source with (id, clean): one row per id."""
    _cte(f"{prefix}_words", f"""
  SELECT id, w, lower(w) AS l, (w = upper(w) AND w <> lower(w)) AS up, row_number() OVER (PARTITION BY id ORDER BY ord) AS pos
  FROM (SELECT id, ord, regexp_replace(raw, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g') AS w
        FROM (SELECT id, unnest(string_split(clean, ' ')) AS raw, generate_subscripts(string_split(clean, ' '), 1) AS ord FROM {source}))
  WHERE length(w) > 1""", source)
    _cte(f"{prefix}_flags", f"""
  SELECT id, count(*) AS n, count(*) FILTER (up) BETWEEN 1 AND count(*) - 1 AS caps, min(pos) FILTER (l = 'but') AS but
  FROM {prefix}_words GROUP BY id""", f"{prefix}_words")
    lags = ", ".join(f"lag(l, {i}) OVER o AS l{i}, lag(up, {i}) OVER o AS u{i}" for i in (1, 2, 3))
    _cte(f"{prefix}_ctx", f"SELECT *, {lags} FROM {prefix}_words WINDOW o AS (PARTITION BY id ORDER BY pos)", f"{prefix}_words")
    _cte(f"{prefix}_v0", f"""
  SELECT c.*, f.caps, f.but, x.valence + CASE WHEN f.caps AND c.up THEN CASE WHEN x.valence > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END AS v
  FROM {prefix}_ctx c JOIN {lex} x ON x.token = c.l JOIN {prefix}_flags f ON f.id = c.id
  WHERE c.l NOT IN (SELECT word FROM {boost})""", f"{prefix}_ctx", f"{prefix}_flags", lex, boost)
    for i, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
        _cte(f"{prefix}_v{i}", f"""
  SELECT p.* EXCLUDE (v), CASE WHEN p.l{i} IS NULL OR k.token IS NOT NULL THEN p.v ELSE
    (p.v + CASE WHEN b.amount IS NULL THEN 0 ELSE
       (CASE WHEN p.v < 0 THEN -b.amount ELSE b.amount END
        + CASE WHEN p.caps AND p.u{i} THEN CASE WHEN p.v > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END) * {damp}::DOUBLE END)
    * CASE WHEN p.l{i} IN {_in(negations)} OR contains(p.l{i}, 'n''t') THEN -0.74::DOUBLE ELSE 1::DOUBLE END END AS v
  FROM {prefix}_v{i - 1} p LEFT JOIN {lex} k ON k.token = p.l{i} LEFT JOIN {boost} b ON b.word = p.l{i}""", f"{prefix}_v{i - 1}", lex, boost)
    _cte(f"{prefix}_sums", f"""
  SELECT id, round(sum(w), 6) AS s, round(sum(CASE WHEN w > 0 THEN w + 1 ELSE 0 END), 6) AS p,
         round(sum(CASE WHEN w < 0 THEN 1 - w ELSE 0 END), 6) AS m, count(*) FILTER (w <> 0) AS hit
  FROM (SELECT id, v * CASE WHEN but IS NULL OR pos = but THEN 1 WHEN pos < but THEN 0.5 ELSE 1.5 END AS w FROM {prefix}_v3)
  GROUP BY id""", f"{prefix}_v3")
    _cte(f"{prefix}_raw", f"""
  SELECT t.id, coalesce(f.n, 0) AS n, coalesce(s.hit, 0) AS hit, coalesce(s.s, 0) AS s, coalesce(s.p, 0) AS p, coalesce(s.m, 0) AS m,
         least(length(t.clean) - length(replace(t.clean, '!', '')), 4) * 0.292::DOUBLE
         + CASE WHEN length(t.clean) - length(replace(t.clean, '?', '')) <= 1 THEN 0
                WHEN length(t.clean) - length(replace(t.clean, '?', '')) <= 3 THEN (length(t.clean) - length(replace(t.clean, '?', ''))) * 0.18::DOUBLE
                ELSE 0.96 END AS e
  FROM {source} t LEFT JOIN {prefix}_flags f ON f.id = t.id LEFT JOIN {prefix}_sums s ON s.id = t.id""",
         source, f"{prefix}_flags", f"{prefix}_sums")
    _cte(f"{prefix}_emph", f"""
  SELECT id, n - hit AS neu, CASE WHEN s > 0 THEN s + e WHEN s < 0 THEN s - e ELSE 0 END AS s,
         CASE WHEN p > m THEN p + e ELSE p END AS p, CASE WHEN m > p THEN m + e ELSE m END AS m FROM {prefix}_raw""", f"{prefix}_raw")
    _cte(f"{prefix}_scores", f"""
  SELECT id, CASE WHEN p + m + neu > 0 THEN round(p / (p + m + neu), 3) ELSE 0 END AS lex_pos,
         CASE WHEN p + m + neu > 0 THEN round(m / (p + m + neu), 3) ELSE 0 END AS lex_neg,
         CASE WHEN p + m + neu > 0 THEN round(neu / (p + m + neu), 3) ELSE 0 END AS lex_neu,
         round(s / sqrt(s * s + 15), 4) AS lex_compound FROM {prefix}_emph""", f"{prefix}_emph")


_cte("t_src", f"SELECT ticket_id AS id, {_clean('text')} AS clean FROM tickets", "tickets")
_sentiment("t", "t_src")
_cte("d_src", f"SELECT doc_id AS id, {_clean('text')} AS clean FROM documents")
_sentiment("d", "d_src")
_cte("m_src", f"SELECT ticket_id AS id, {_clean('text')} AS clean FROM messy", "messy")
_sentiment("m", "m_src")


# Texts with phrases and emoticons, which SQL replaces by single words of its own.
PHRASED = (" It was kind of good", " Without a doubt helpful, but not only slow", " We are FED UP with bad staff :(", " It is by no means great :D", " This is a waste of time", " more or less nice, never so happy <3")
_cte("phrased", "SELECT ticket_id, rtrim(text, '.!?') || '.' || " + _list(PHRASED) + f"[CAST(substr(ticket_id, 5) AS BIGINT) % {len(PHRASED)} + 1] AS text FROM tickets", "tickets")
_merged = _clean("text")
for _phrase in sorted((*PHRASE_VALENCES, *PHRASE_BOOSTS, *PHRASE_NEGATIONS, *PHRASES_WITHOUT_EFFECT), key=lambda p: -len(p)):
    _groups, _n = " ".join(f"({w})" for w in _phrase.split()), len(_phrase.split())
    _merged = f"regexp_replace({_merged}, '(^|[^\\pL\\pN]){_groups}($|[^\\pL\\pN])', '{chr(92)}1" + "_".join(f"{chr(92)}{i + 2}" for i in range(_n)) + f"{chr(92)}{_n + 2}', 'gi')"
for _i, _sign in enumerate(EMOTICONS):
    _merged = f"replace({_merged} || ' ', ' {_sign.replace(chr(39), chr(39) * 2)} ', ' emoticon{_i} ')"
_cte("p_src", f"SELECT ticket_id AS id, {_merged} AS clean FROM phrased", "phrased")
_cte("p_lex", "SELECT * FROM lex UNION ALL SELECT * FROM (VALUES " + ", ".join(
    [f"({_q(p.replace(' ', '_'))}, {v}::DOUBLE)" for p, v in PHRASE_VALENCES.items()] + [f"('emoticon{i}', {v}::DOUBLE)" for i, v in enumerate(EMOTICONS.values())]) + ") AS e(token, valence)", "lex")
_cte("p_boost", "SELECT * FROM boost UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({_q(p.replace(' ', '_'))}, {v}::DOUBLE)" for p, v in PHRASE_BOOSTS.items()) + ") AS e(word, amount)", "boost")
_sentiment("p", "p_src", "p_lex", "p_boost", (*NEGATIONS, *(p.replace(" ", "_") for p in PHRASE_NEGATIONS)))


def _hybrid(compound: str, label: str, score: str) -> str:
    return f"(0.4::DOUBLE * {compound} + (1 - 0.4::DOUBLE) * CASE {label} WHEN 'positive' THEN {score} WHEN 'negative' THEN -{score} ELSE 0 END)"


def _label(h: str) -> str:
    return f"CASE WHEN {h} >= 0.15 THEN 'positive' WHEN {h} <= -0.15 THEN 'negative' ELSE 'neutral' END"


_cte("scored", f"""
  SELECT t.*, {_label(_hybrid('s.lex_compound', "'neutral'", '0'))} AS sentiment_label,
         round(least(abs(0.4::DOUBLE * s.lex_compound), 1), 4) AS sentiment_confidence, s.lex_compound, 0::DOUBLE AS model_score,
         s.lex_pos, s.lex_neg, s.lex_neu, s.lex_compound < -0.7 AS is_critical
  FROM tickets t JOIN t_scores s ON s.id = t.ticket_id""", "tickets", "t_scores")

# Mentions: patterns and names.
_MONEY = r"(?i)\$[\d,]+(?:\.\d{1,2})?|[\d,]+\s*(?:dollars?|usd)"
_DATE = r"\b\d{4}-\d{2}-\d{2}\b"


def _pattern(name: str, pattern: str, label: str) -> None:
    _cte(f"{name}_found", f"""
  SELECT ticket_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM stripped""", "stripped")
    _cte(name, f"""
  SELECT ticket_id, entity, '{label}' AS entity_type, CAST(start AS INTEGER) AS "start", CAST(start + length(entity) AS INTEGER) AS "end"
  FROM (SELECT ticket_id, m[i] AS entity,
          list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
        FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM {name}_found WHERE len(m) > 0))""", f"{name}_found")


_cte("stripped", f"SELECT ticket_id, s AS text FROM (SELECT ticket_id, {_strip('text')} AS s FROM tickets) WHERE length(s) >= 2", "tickets")
_pattern("money", _MONEY, "MONEY")
_pattern("dates", _DATE, "DATE")
_cte("patterns", "SELECT * FROM money UNION ALL SELECT * FROM dates", "money", "dates")
_cte("gaz", """
  SELECT DISTINCT lower(name) AS name, label FROM (
    SELECT p_name AS name, 'PRODUCT' AS label FROM part UNION ALL SELECT n_name, 'GPE' FROM nation
    UNION ALL SELECT s_name, 'ORG' FROM supplier UNION ALL SELECT c_name, 'PERSON' FROM customer
    UNION ALL SELECT unnest(['legal', 'safety', 'harbour street depot']), 'ORG')""")
_cte("named", """
  SELECT ticket_id, substr(text, CAST(pos AS INTEGER) + 1, length(name)) AS entity, label AS entity_type, CAST(pos AS INTEGER) AS "start",
         CAST(pos + length(name) AS INTEGER) AS "end"
  FROM (SELECT *, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(name) AS pos
        FROM (SELECT *, unnest(range(1, len(parts))) AS i
              FROM (SELECT s.ticket_id, s.text, g.name, g.label, string_split(lower(s.text), g.name) AS parts FROM stripped s JOIN gaz g ON contains(lower(s.text), g.name))))
  WHERE NOT (pos > 0 AND regexp_matches(substr(text, CAST(pos AS INTEGER), 1), '[\\pL\\pN_]') AND regexp_matches(name, '^[\\pL\\pN_]'))
    AND NOT (regexp_matches(substr(text, CAST(pos AS INTEGER) + length(name) + 1, 1), '[\\pL\\pN_]') AND regexp_matches(name, '[\\pL\\pN_]$'))""", "stripped", "gaz")
_cte("all_mentions", "SELECT * FROM patterns UNION ALL SELECT * FROM named", "patterns", "named")
_cte("mentions", """
  SELECT ticket_id, entity, entity_type, "start", "end" FROM (
    SELECT *, max("end") OVER (PARTITION BY ticket_id ORDER BY "start", "end" DESC, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM all_mentions WHERE entity_type IN ('PERSON', 'ORG', 'PRODUCT', 'DATE', 'MONEY', 'GPE'))
  WHERE reach IS NULL OR "start" >= reach""", "all_mentions")
_cte("entity_n", "SELECT entity, entity_type, count(*) AS n FROM mentions GROUP BY ALL", "mentions")
_has_complaint = " OR ".join(f"contains(lower(text), {_q(w)})" for w in COMPLAINT_KEYWORDS)
_cte("critical_e", f"""
  SELECT n.entity, n.entity_type, n.n AS frequency, CASE WHEN n.entity_type = 'PRODUCT' THEN 'product_mentioned_in_complaint'
         ELSE printf('high_value_amount_%.2f', TRY_CAST(regexp_replace(n.entity, '[^0-9.]', '', 'g') AS DOUBLE)) END AS reason
  FROM entity_n n WHERE (n.entity_type = 'MONEY' AND TRY_CAST(regexp_replace(n.entity, '[^0-9.]', '', 'g') AS DOUBLE) > 100)
     OR (n.entity_type = 'PRODUCT' AND EXISTS (
       SELECT 1 FROM mentions m JOIN tickets t USING (ticket_id) WHERE m.entity = n.entity AND m.entity_type = 'PRODUCT' AND ({_has_complaint})))""",
     "entity_n", "mentions", "tickets")

# Report inputs: topics are category and channel.
_cat_no = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, (c, _, _t) in enumerate(CATEGORIES)) + " END"
_ch_no = "CASE channel " + " ".join(f"WHEN '{c}' THEN {i}" for i, (c, _b) in enumerate(CHANNELS)) + " END"
_cte("r_topics", f"SELECT ticket_id, CAST({_cat_no} * 5 + {_ch_no} AS INTEGER) AS topic, category || '/' || channel AS topic_label FROM tickets", "tickets")
_cte("r_sentiment", "SELECT ticket_id, sentiment_label, lex_compound AS sentiment_score FROM scored", "scored")
_cte("r_entities", "SELECT ticket_id, entity, entity_type FROM mentions", "mentions")
_cte("topic_n", "SELECT topic_label, count(*) AS n FROM r_topics WHERE topic_label IS NOT NULL GROUP BY 1", "r_topics")
_cte("pie", """
  SELECT CASE WHEN rn <= 8 THEN topic_label ELSE 'Other' END AS topic_label, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT *, row_number() OVER (ORDER BY n DESC, topic_label) AS rn FROM topic_n) GROUP BY 1""", "topic_n")
_cte("per_type", "SELECT entity_type, entity, count(DISTINCT ticket_id) AS tickets FROM r_entities GROUP BY 1, 2", "r_entities")
_cte("heat", """
  SELECT a.entity_type AS type_a, b.entity_type AS type_b, CAST(coalesce(sum(x.tickets * y.tickets), 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT entity_type FROM per_type) a CROSS JOIN (SELECT DISTINCT entity_type FROM per_type) b
  LEFT JOIN per_type x ON x.entity_type = a.entity_type LEFT JOIN per_type y ON y.entity_type = b.entity_type AND y.entity = x.entity
  GROUP BY 1, 2""", "per_type")
_cte("critical_t", f"""
  SELECT ticket_id, {_list(FLAG_REASONS)}[source + 1] AS flag_reason, sentiment_score, entity, priority, source AS source_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY source, sentiment_score, entity, priority) AS rn FROM (
      SELECT ticket_id, 0 AS source, sentiment_score, NULL AS entity, NULL AS priority FROM r_sentiment WHERE sentiment_score <= -0.6
      UNION ALL SELECT ticket_id, 1, NULL, entity, NULL FROM r_entities WHERE lower(entity) IN {_in(CRITICAL_ENTITY_WORDS)}
      UNION ALL SELECT ticket_id, 2, NULL, NULL, priority FROM tickets WHERE lower(priority) IN {_in(CRITICAL_PRIORITIES)})) WHERE rn = 1""",
     "r_sentiment", "r_entities", "tickets")
_cte("summary", f"""
  SELECT total_tickets, positive, neutral, negative, avg_sentiment, top_topic, top_topic_count, critical_count,
         {_pct('top_topic_count', 'total_tickets')} AS top_topic_pct, {_pct('critical_count', 'total_tickets')} AS critical_pct
  FROM (SELECT greatest((SELECT count(*) FROM r_topics), (SELECT count(*) FROM r_sentiment), (SELECT count(*) FROM r_entities)) AS total_tickets,
          (SELECT count(*) FROM r_sentiment WHERE sentiment_label = 'positive') AS positive,
          (SELECT count(*) FROM r_sentiment WHERE sentiment_label = 'neutral') AS neutral,
          (SELECT count(*) FROM r_sentiment WHERE sentiment_label = 'negative') AS negative,
          (SELECT {_mean('avg(sentiment_score)', 3)} FROM r_sentiment) AS avg_sentiment,
          (SELECT topic_label FROM topic_n ORDER BY n DESC, topic_label LIMIT 1) AS top_topic,
          (SELECT n FROM topic_n ORDER BY n DESC, topic_label LIMIT 1) AS top_topic_count,
          (SELECT count(*) FROM critical_t) AS critical_count)""", "r_topics", "r_sentiment", "r_entities", "topic_n", "critical_t")


_advice_leading = (
    "'Focus resources on ''' || top_topic || ''' — the leading complaint category accounting for ' || top_topic_pct "
    "|| ' of all tickets (' || format('{:,}', top_topic_count) || ' tickets).'"
)
_cte("advice", f"""
  SELECT list_filter([
    CASE WHEN top_topic <> 'N/A' THEN {_advice_leading} END,
    CASE WHEN avg_sentiment < 0 THEN printf({_q(rp.ADVICE_NEGATIVE_MEAN)}, round(avg_sentiment, 2)) END,
    CASE WHEN critical_count > 0 THEN printf({_q(rp.ADVICE_CRITICAL)}, critical_count, critical_pct) END,
    CASE WHEN negative / total_tickets * 100 > 30 THEN printf({_q(rp.ADVICE_NEGATIVE_SHARE)}, round(negative / total_tickets * 100, 1)) END,
    CASE WHEN (SELECT count(*) FROM topic_n) >= 3 THEN printf({_q(rp.ADVICE_TOP_THREE)}, round(
      (SELECT sum(n) FROM (SELECT n FROM topic_n ORDER BY n DESC, topic_label LIMIT 3)) / total_tickets * 100, 1)) END
  ], lambda x: x IS NOT NULL) AS a FROM summary""", "summary", "topic_n")
_cte("recs", "SELECT CAST(unnest(generate_series(1, len(a))) AS INTEGER) AS ord, unnest(a) AS recommendation FROM advice", "advice")


def _terms(prefix: str, source: str) -> None:
    """Term statistics for a source with (id, topic, text)."""
    _cte(f"{prefix}_tok", f"""
  SELECT id, topic, t, row_number() OVER (PARTITION BY id ORDER BY ord) AS pos FROM (
    SELECT id, topic, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}')) AS t,
           generate_subscripts(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}'), 1) AS ord FROM {source})
  WHERE t NOT IN {_in(STOP_WORDS)}""", source)
    _cte(f"{prefix}_gram", f"""
  SELECT id, topic, t AS term FROM {prefix}_tok UNION ALL
  SELECT id, topic, t || ' ' || nxt FROM (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM {prefix}_tok) WHERE nxt IS NOT NULL""",
         f"{prefix}_tok")
    _cte(f"{prefix}_tf", f"""
  SELECT g.topic, g.term, count(*) AS tf, any_value(d.df) AS df FROM {prefix}_gram g
  JOIN (SELECT term, count(DISTINCT id) AS df FROM {prefix}_gram GROUP BY term) d ON d.term = g.term
  WHERE d.df >= 2 AND d.df <= 0.95::DOUBLE * (SELECT count(*) FROM {source}) GROUP BY 1, 2""", f"{prefix}_gram", source)
    _cte(f"{prefix}_w", f"""
  SELECT topic, term, tf / sum(tf) OVER (PARTITION BY topic)
         * ln(1 + (SELECT sum(tf) / count(DISTINCT topic) FROM {prefix}_tf) / sum(tf) OVER (PARTITION BY term)) AS weight FROM {prefix}_tf""", f"{prefix}_tf")
    _cte(f"{prefix}_kw", f"""
  SELECT topic, CAST(rn AS INTEGER) AS "rank", term, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rn FROM {prefix}_w) WHERE rn <= 10""", f"{prefix}_w")


_cte("tt_src", "SELECT r.ticket_id AS id, r.topic, t.text FROM r_topics r JOIN tickets t USING (ticket_id)", "r_topics", "tickets")
_terms("tt", "tt_src")
_cte("dt_src", "SELECT doc_id AS id, lang AS topic, text FROM documents")
_terms("dt", "dt_src")
_cte("et_src", "SELECT d.doc_id AS id, e.label AS topic, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
_terms("et", "et_src")
_cte("centroid", """
  SELECT topic, list(m ORDER BY ord) AS centroid FROM (
    SELECT label AS topic, ord, avg(x) AS m FROM (
      SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS ord FROM embeddings) GROUP BY 1, 2)
  GROUP BY topic""")
_cte("sims", """
  SELECT e.vec_id, e.label, c.topic, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centroid) AS sim FROM embeddings e CROSS JOIN centroid c""", "centroid")
_cte("tt_info", """
  SELECT c.topic, c.n AS "count", CAST(c.topic AS VARCHAR) || '_' || array_to_string(k.words[1:4], '_') AS name, array_to_string(k.words, ' | ') AS keywords
  FROM (SELECT topic, count(*) AS n FROM r_topics GROUP BY 1) c JOIN (SELECT topic, list(term ORDER BY "rank") AS words FROM tt_kw GROUP BY 1) k USING (topic)""",
     "r_topics", "tt_kw")


def compose(final: str) -> str:
    """Put the named parts that a query reads in front of it, in order."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for read in CTE[name][0]:
            visit(read)
        needed.append(name)

    for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", final)):
        if word in CTE and re.search(rf"(FROM|JOIN)\s+{word}\b", final):
            visit(word)
    if not needed:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in needed) + "\n" + final
