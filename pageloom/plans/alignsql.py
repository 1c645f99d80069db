"""SQL that walks the words of two texts side by side, to compare the alignment with."""

from __future__ import annotations

from pageloom.operators.align import SHAPES

_WORDS = "list_filter(regexp_split_to_array({0}, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+'), lambda q: q <> '')"
# every character of a pair of texts has a byte of its own, as the edit distance there goes by bytes
_BYTES = "list_transform({0}, lambda w: list_reduce(list_prepend('', list_transform(string_split(w, ''), lambda q: chr(list_position(abc, q)::INT))), lambda p, q: p || q))"


def walked(pairs: str) -> str:
    """CTEs that end in `met` (id, page_id, kind, x, y, ex, ey): the unequal words met by the walk, with kind where a blank was added or lost; pairs: CTEs that end in pp (id, page_id, ocr, clean)."""
    return f"""{pairs}, ws AS (SELECT id, page_id, {_WORDS.format('clean')} AS g, {_WORDS.format('ocr')} AS o, list_distinct(string_split(clean || ocr, '')) AS abc FROM pp),
enc AS (SELECT id, page_id, g, o, {_BYTES.format('g')} AS ge, {_BYTES.format('o')} AS oe FROM ws),
walk AS (SELECT id, 1 AS i, 1 AS j, NULL::VARCHAR AS kind, ''::VARCHAR AS x, ''::VARCHAR AS y, ''::VARCHAR AS ex, ''::VARCHAR AS ey FROM enc UNION ALL
    SELECT id, i + CASE WHEN kind = 'space_removed' THEN 2 ELSE 1 END, j + CASE WHEN kind = 'space_added' THEN 2 ELSE 1 END, kind,
           CASE WHEN kind = 'same' THEN '' WHEN kind = 'space_removed' THEN a || a2 ELSE a END, CASE WHEN kind = 'same' THEN '' WHEN kind = 'space_added' THEN b || b2 ELSE b END, CASE WHEN kind = 'space_removed' THEN a || ' ' || a2 ELSE a END, CASE WHEN kind = 'space_added' THEN b || ' ' || b2 ELSE b END FROM (
        SELECT *, CASE WHEN a = b THEN 'same' WHEN direct <= least(coalesce(added, direct), coalesce(lost, direct)) THEN 'pair' WHEN added IS NOT NULL AND added <= coalesce(lost, added) THEN 'space_added' ELSE 'space_removed' END AS kind FROM (
            SELECT w.id, w.i, w.j, g[i] AS a, o[j] AS b, g[i + 1] AS a2, o[j + 1] AS b2, levenshtein(ge[i], oe[j]) AS direct,
                   CASE WHEN length(g[i]) > length(o[j]) AND j < len(o) THEN levenshtein(ge[i], oe[j] || oe[j + 1]) END AS added, CASE WHEN length(o[j]) > length(g[i]) AND i < len(g) THEN levenshtein(ge[i] || ge[i + 1], oe[j]) END AS lost
            FROM walk w JOIN enc USING (id) WHERE w.i <= len(g) AND w.j <= len(o)))),
met AS (SELECT id, page_id, kind, x, y, ex, ey FROM walk JOIN enc USING (id) WHERE kind <> 'same')"""


def counted(pairs: str) -> str:
    """CTEs that end in `errors` (kind, gt_char, ocr_char, n): substitutions of one shortest script of each two words, blanks, and shapes."""
    shapes = []
    for two, one in SHAPES:
        for left, right in ((one, two), (two, one)):
            at = f"len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, i, {len(left)}) = '{left}' AND substr(y, i, {len(right)}) = '{right}'))"
            shapes.append(f"SELECT 'visual' AS kind, '{left}' AS gt_char, '{right}' AS ocr_char, sum(n * {at}) AS n FROM xy")
    return f"""{walked(pairs)},
xy AS MATERIALIZED (SELECT row_number() OVER () AS p, x, y, n FROM (SELECT x, y, count(*) AS n FROM met GROUP BY ALL)),
dp AS (SELECT p, 0 AS i, unnest(range(0, length(y) + 1)) AS j, unnest(range(0, length(y) + 1)) AS v FROM xy UNION ALL
    SELECT p, i, j, j + min(q - j) OVER (PARTITION BY p ORDER BY j ROWS UNBOUNDED PRECEDING) FROM (
        SELECT dp.p, dp.i + 1 AS i, dp.j, least(dp.v + 1, coalesce(lag(dp.v) OVER (PARTITION BY dp.p ORDER BY dp.j) + (substr(xy.x, dp.i::INT + 1, 1) <> substr(xy.y, dp.j::INT, 1))::INT, dp.i + 1)) AS q FROM dp JOIN xy USING (p) WHERE dp.i < length(xy.x))),
dm AS MATERIALIZED (SELECT p, i::INT AS i, j::INT AS j, v FROM dp),
back AS (SELECT p, length(x)::INT AS i, length(y)::INT AS j, '' AS s, '' AS t FROM xy UNION ALL
    SELECT p, CASE WHEN how = 'ins' THEN i ELSE i - 1 END, CASE WHEN how = 'del' THEN j ELSE j - 1 END, CASE WHEN how = 'sub' THEN a ELSE '' END, CASE WHEN how = 'sub' THEN b ELSE '' END FROM (
        SELECT k.p, k.i, k.j, substr(x, k.i, 1) AS a, substr(y, k.j, 1) AS b, CASE WHEN k.i > 0 AND k.j > 0 AND here.v = dia.v + (substr(x, k.i, 1) <> substr(y, k.j, 1))::INT THEN CASE WHEN substr(x, k.i, 1) <> substr(y, k.j, 1) THEN 'sub' ELSE 'same' END WHEN k.i > 0 AND here.v = up.v + 1 THEN 'del' ELSE 'ins' END AS how
        FROM back k JOIN xy USING (p) JOIN dm here ON here.p = k.p AND here.i = k.i AND here.j = k.j LEFT JOIN dm dia ON dia.p = k.p AND dia.i = k.i - 1 AND dia.j = k.j - 1 LEFT JOIN dm up ON up.p = k.p AND up.i = k.i - 1 AND up.j = k.j WHERE k.i > 0 OR k.j > 0)),
every AS (SELECT 'sub' AS kind, s AS gt_char, t AS ocr_char, sum(n) AS n FROM back JOIN xy USING (p) WHERE s <> '' GROUP BY ALL
    UNION ALL SELECT kind, CASE WHEN kind = 'space_added' THEN '' ELSE ' ' END, CASE WHEN kind = 'space_added' THEN ' ' ELSE '' END, count(*) FROM met WHERE kind <> 'pair' GROUP BY ALL UNION ALL {' UNION ALL '.join(shapes)}),
errors AS (SELECT kind, gt_char, ocr_char, n::BIGINT AS n FROM every WHERE n > 0)"""
