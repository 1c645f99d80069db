"""SQL that gives stemmed tokens and their overlaps, to compare the metrics with."""

from __future__ import annotations

from pageloom.functions.stem import STEP2, STEP3, STEP4


def _pattern(x: str) -> str:
    """Consonants and vowels of a word as c and v; y is a vowel after a consonant."""
    y = f"replace(regexp_replace(regexp_replace({x}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), 'yy', 'yY')"
    return f"regexp_replace(regexp_replace({y}, '[aeiouy]', 'v', 'g'), '[^v]', 'c', 'g')"


def _measure(x: str) -> str:
    return f"((length({x}) - length(replace({_pattern(x)}, 'vc', ''))) // 2)"


def _vowel(x: str) -> str:
    return f"contains({_pattern(x)}, 'v')"


def _double(x: str) -> str:
    return f"(length({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) AND right({_pattern(x)}, 1) = 'c')"


def _cvc(x: str) -> str:
    return f"(right({_pattern(x)}, 3) = 'cvc' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _but(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _table(pairs: tuple[tuple[str, str], ...]) -> str:
    rows = [f"WHEN w LIKE '%{s}' THEN CASE WHEN {_measure(_but(len(s)))} > 0 THEN {_but(len(s))} || '{new}' ELSE w END" for s, new in sorted(pairs, key=lambda p: -len(p[0]))]
    return f"CASE {' '.join(rows)} ELSE w END"


def stems(source: str) -> str:
    """CTEs that end in `stems` (word, stem), from a table with the column word."""
    last = []
    for s in sorted(STEP4, key=len, reverse=True):
        more = f" AND right({_but(3)}, 1) IN ('s', 't')" if s == "ion" else ""
        last.append(f"WHEN w LIKE '%{s}' THEN CASE WHEN {_measure(_but(len(s)))} > 1{more} THEN {_but(len(s))} ELSE w END")
    steps = (
        "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END",
        None,
        f"CASE WHEN w LIKE '%y' AND {_vowel(_but(1))} THEN {_but(1)} || 'i' ELSE w END", _table(STEP2), _table(STEP3), f"CASE {' '.join(last)} ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({_measure(_but(1))} > 1 OR ({_measure(_but(1))} = 1 AND NOT {_cvc(_but(1))})) THEN {_but(1)} ELSE w END",
        f"CASE WHEN w LIKE '%l' AND {_measure('w')} > 1 AND {_double('w')} THEN {_but(1)} ELSE w END",
    )
    out = [f"z0 AS (SELECT DISTINCT word, word AS w FROM {source} WHERE length(word) > 3)"]
    for k, step in enumerate(steps):
        if step:
            out.append(f"z{k + 1} AS (SELECT word, {step} AS w FROM z{k})")
            continue
        cut = f"CASE WHEN w LIKE '%eed' THEN NULL WHEN w LIKE '%ed' AND {_vowel(_but(2))} THEN {_but(2)} WHEN w LIKE '%ing' AND {_vowel(_but(3))} THEN {_but(3)} END"
        mend = f"CASE WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e' WHEN {_double('s')} AND right(s, 1) NOT IN ('l', 's', 'z') THEN left(s, length(s) - 1) WHEN {_measure('s')} = 1 AND {_cvc('s')} THEN s || 'e' ELSE s END"
        out.append(f"z{k + 1} AS (SELECT word, CASE WHEN s IS NOT NULL THEN {mend} WHEN w LIKE '%eed' AND {_measure(_but(3))} > 0 THEN {_but(1)} ELSE w END AS w FROM (SELECT word, w, {cut} AS s FROM z{k}))")
    return ",\n".join(out) + f",\nstems AS (SELECT word, w AS stem FROM z{len(steps)})"


def overlaps(answers: str, which: str) -> str:
    """CTEs that end in `rouge` (id, p1, r1, f1, p2, r2, f2, pl, rl, fl) of a table `which` with id, ground_truth and answer; answers: CTEs before it.

    The longest common subsequence is built one reference token a step, for all
    texts at once, after the tokens both begin and end with are taken off.
    """
    tokens = lambda c: f"list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda q: q <> '')"
    prf = lambda h, n: f"coalesce({h} / nullif(m{n}, 0), 0.0) AS p{n}, coalesce({h} / nullif(n{n}, 0), 0.0) AS r{n}"
    return f"""{answers}, tk AS (SELECT id, 0 AS side_, {tokens('ground_truth')} AS ws FROM {which} UNION ALL SELECT id, 1, {tokens('answer')} FROM {which}),
tp AS (SELECT id, side_, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM tk),
{stems('tp')},
st AS (SELECT id, side_, pos, coalesce(stem, tp.word) AS s FROM tp LEFT JOIN stems USING (word)),
sl AS (SELECT k.id, coalesce(a.l, []) AS x, coalesce(b.l, []) AS y FROM {which} k LEFT JOIN (SELECT id, list(s ORDER BY pos) AS l FROM st WHERE side_ = 0 GROUP BY id) a USING (id) LEFT JOIN (SELECT id, list(s ORDER BY pos) AS l FROM st WHERE side_ = 1 GROUP BY id) b USING (id)),
g1 AS (SELECT id, side_, s AS g, count(*) AS n FROM st GROUP BY ALL), g2 AS (SELECT id, side_, g, count(*) AS n FROM (SELECT id, side_, s || ' ' || lead(s) OVER (PARTITION BY id, side_ ORDER BY pos) AS g FROM st) WHERE g IS NOT NULL GROUP BY ALL),
h1 AS (SELECT a.id, sum(least(a.n, b.n)) AS h1 FROM g1 a JOIN g1 b USING (id, g) WHERE a.side_ = 0 AND b.side_ = 1 GROUP BY ALL), h2 AS (SELECT a.id, sum(least(a.n, b.n)) AS h2 FROM g2 a JOIN g2 b USING (id, g) WHERE a.side_ = 0 AND b.side_ = 1 GROUP BY ALL),
lf AS (SELECT *, least(len(x), len(y)) AS n, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) - 1, least(len(x), len(y))) AS a FROM sl),
lg AS (SELECT id, x, y, a, coalesce(list_position(list_transform(range(0, n - a), lambda i: x[len(x) - i] = y[len(y) - i]), false) - 1, n - a) AS z FROM lf),
lm AS (SELECT id, a + z AS same, x[a + 1 : len(x) - z] AS x, y[a + 1 : len(y) - z] AS y FROM lg),
lx AS MATERIALIZED (SELECT id, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM lm), ly AS (SELECT id, 0 AS i, generate_subscripts(y, 1) AS j, 0 AS v, unnest(y) AS c FROM lm),
lr AS (SELECT id, i, j, v, c FROM ly UNION ALL
  SELECT id, i, j, max(q) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING), c FROM (SELECT lr.id, lr.i + 1 AS i, lr.j, lr.c, greatest(lr.v, coalesce(lag(lr.v) OVER (PARTITION BY lr.id ORDER BY lr.j), 0) + (lx.c = lr.c)::INT) AS q FROM lr JOIN lx ON lx.id = lr.id AND lx.i = lr.i + 1)),
hl AS (SELECT lm.id, same + coalesce(max(v), 0) AS hl FROM lm LEFT JOIN lr ON lr.id = lm.id AND lr.i = len(lm.x) GROUP BY lm.id, same),
hits AS (SELECT sl.id, coalesce(h1, 0)::DOUBLE AS h1, coalesce(h2, 0)::DOUBLE AS h2, hl::DOUBLE AS hl, len(x) AS n1, len(y) AS m1, greatest(len(x) - 1, 0) AS n2, greatest(len(y) - 1, 0) AS m2, len(x) AS nl, len(y) AS ml FROM sl LEFT JOIN h1 USING (id) LEFT JOIN h2 USING (id) JOIN hl USING (id)),
pr AS (SELECT id, {prf('h1', '1')}, {prf('h2', '2')}, {prf('hl', 'l')} FROM hits),
rouge AS (SELECT *, {', '.join(f"CASE WHEN p{n} + r{n} > 0 THEN 2 * p{n} * r{n} / (p{n} + r{n}) ELSE 0.0 END AS f{n}" for n in ('1', '2', 'l'))} FROM pr)"""
