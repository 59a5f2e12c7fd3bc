"""SQL that grows a tree as ``plans.chaid`` does: merges, cuts, adjusted p-values and rules, for a yes/no target."""

from __future__ import annotations

from lodeglass.functions.distributions import chi2_tail


def critical(alpha: float) -> float:
    """The statistic with one degree of freedom whose tail is ``alpha``."""
    low, high = 0.0, 100.0
    while (middle := (low + high) / 2) not in (low, high):
        low, high = (middle, high) if chi2_tail(middle, 1) > alpha else (low, middle)
    return high


def _stat(v: str) -> str:
    """Chi-squared of two groups of ``n1, n2`` rows with ``h1, h2`` hits, fields of ``v``."""
    t, hits = f"({v}.n1 + {v}.n2)", f"({v}.h1 + {v}.h2)"
    cells = []
    for g in "12":
        for seen, column in ((f"({v}.n{g} - {v}.h{g})", f"({t} - {hits})"), (f"{v}.h{g}", hits)):
            e = f"({v}.n{g} * {column} / {t})"
            cells.append(f"({seen} - {e}) * ({seen} - {e}) / {e}")
    return f"CASE WHEN {hits} = 0 OR {hits} = {t} THEN 0.0 ELSE {' + '.join(cells)} END"


def _of(group: str, values: str) -> str:
    return f"list_sum(list_transform({group}, lambda i: {values}[i]))"


def _tail(x: str, df: str) -> str:
    """Tail of the chi-squared distribution: closed for even degrees; an error function and a sum for odd ones."""
    z = f"sqrt({x} / 2)"
    series = f"list_sum(list_transform(range(0, 60), lambda k: pow(2, k) * pow({z}, 2 * k + 1) / list_product(list_transform(range(0, k + 1), lambda m: 2.0 * m + 1))))"
    near = f"1 - 2 / sqrt(pi()) * exp(-{x} / 2) * {series}"
    fraction = f"list_reduce(list_transform(range(120, 0, -1), lambda k: k::DOUBLE), lambda a, k: {z} + k / 2 / a, {z})"
    far = f"exp(-{x} / 2) / sqrt(pi()) / {fraction}"
    error = f"CASE WHEN {z} < 2 THEN {near} ELSE {far} END"
    odd = f"coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda i: pow({x} / 2, i + 0.5) * exp(-{x} / 2) / gamma(i + 1.5))), 0)"
    even = f"list_sum(list_transform(range(0, {df} // 2), lambda i: pow({x} / 2, i) * exp(-{x} / 2) / gamma(i + 1)))"
    return f"CASE WHEN {df} = 0 THEN 1.0 WHEN {df} % 2 = 1 THEN ({error}) + {odd} ELSE {even} END"


def _level(k: int, min_leaf: int, alpha: float, alpha_resplit: float, numeric: list[str]) -> str:
    """CTEs ``c, s, f, b`` of level ``k`` over ``l`` (key, hit, node, p, c): the best split of each node, with its groups."""
    ordered = f"p IN ({', '.join(repr(n) for n in numeric)})"
    pairs = (
        "CASE WHEN ord THEN list_transform(range(1, len(groups)), lambda i: {'i': i, 'j': i + 1}) ELSE "
        "flatten(list_transform(range(1, len(groups)), lambda i: list_transform(range(i + 1, len(groups) + 1), "
        "lambda j: {'i': i, 'j': j}))) END"
    )
    lefts = (
        "CASE WHEN ord THEN list_transform(range(1, len(g)), lambda k: g[1:k]) ELSE flatten(list_transform([0, 1], lambda j: "
        "list_transform(range(1, len(g)), lambda k: list_sort(list_transform(list_sort(list_transform(g, lambda i: "
        "{'s': (CASE WHEN j = 0 THEN n[i] - h[i] ELSE h[i] END) / n[i], 'i': i}))[1:k], lambda x: x.i))))) END"
    )
    sides = (
        f"list_transform({lefts}, lambda a, k: {{'k': k, 'a': a, 'b': list_filter(g, lambda i: NOT list_contains(a, i))}})"
    )
    sized = (
        f"list_transform({sides}, lambda w: {{'k': w.k, 'a': w.a, 'b': w.b, 'n1': {_of('w.a', 'n')}, 'h1': {_of('w.a', 'h')}, "
        f"'n2': {_of('w.b', 'n')}, 'h2': {_of('w.b', 'h')}}})"
    )
    kept = f"list_filter({sized}, lambda w: w.n1 >= {min_leaf} AND w.n2 >= {min_leaf})"
    cut = (
        f"list_sort(list_transform({kept}, lambda w: {{'s': -({_stat('w')}), 'k': w.k, 'a': w.a, 'b': w.b}}))[1]"
    )
    recut = (
        f"list_sort(flatten(list_transform(groups, lambda g: CASE WHEN len(g) < 3 THEN [g] ELSE list_transform([{cut}], "
        f"lambda w: CASE WHEN w IS NOT NULL AND -w.s >= {critical(alpha_resplit)!r} THEN [w.a, w.b] ELSE [g] END)[1] END)))"
    )
    return f"""
c{k} AS (SELECT node, p, {ordered} AS ord, list(c ORDER BY c) AS cats, list(n ORDER BY c) AS n, list(h ORDER BY c) AS h
  FROM (SELECT node, p, c, count(*)::DOUBLE AS n, sum(hit)::DOUBLE AS h FROM l{k} GROUP BY ALL)
  GROUP BY node, p HAVING count(*) > 1),
s{k} AS (
  SELECT *, list_transform(range(1, len(cats) + 1), lambda i: [i]) AS groups, 'merge' AS phase,
         [list_transform(range(1, len(cats) + 1), lambda i: [i])::VARCHAR] AS tried FROM c{k}
  UNION ALL
  SELECT node, p, ord, cats, n, h,
    CASE WHEN phase = 'merge' THEN CASE WHEN stop THEN groups ELSE list_sort(list_concat(
           list_filter(groups, lambda g, i: i <> best.i AND i <> best.j), [list_sort(list_concat(groups[best.i], groups[best.j]))])) END
         WHEN same THEN groups ELSE again END,
    CASE WHEN phase = 'merge' THEN CASE WHEN stop THEN 'done' ELSE 'cut' END
         WHEN NOT same THEN 'cut' WHEN len(groups) < 2 THEN 'done' ELSE 'merge' END,
    CASE WHEN phase = 'cut' AND same THEN list_append(tried, groups::VARCHAR) ELSE tried END
  FROM (SELECT *, NOT small AND best.s >= {critical(alpha)!r} AS stop, again = groups OR list_contains(tried, again::VARCHAR) AS same
    FROM (SELECT *, list_sort(list_transform(list_filter(pairs, lambda v: NOT small OR v.n1 < {min_leaf} OR v.n2 < {min_leaf}),
                 lambda v: {{'s': {_stat('v')}, 'i': v.i, 'j': v.j}}))[1] AS best
      FROM (SELECT *, list_min(gn) < {min_leaf} AS small,
                   list_transform({pairs}, lambda v: {{'i': v.i, 'j': v.j, 'n1': gn[v.i], 'h1': gh[v.i], 'n2': gn[v.j], 'h2': gh[v.j]}}) AS pairs,
                   CASE WHEN phase = 'cut' THEN {recut} ELSE groups END AS again
        FROM (SELECT *, list_transform(groups, lambda g: {_of('g', 'n')}) AS gn, list_transform(groups, lambda g: {_of('g', 'h')}) AS gh
          FROM s{k} WHERE phase <> 'done'))))),
f{k} AS (
  SELECT node, p, cats, groups, len(groups) AS r, len(cats) AS c, ord, list_sum(n) AS n, list_sum(h) AS h,
         list_transform(groups, lambda g: {_of('g', 'n')}) AS gn, list_transform(groups, lambda g: {_of('g', 'h')}) AS gh
  FROM s{k} WHERE phase = 'done' AND len(groups) > 1),
x{k} AS (
  SELECT *, CASE WHEN h = 0 OR h = n THEN 0 ELSE r - 1 END AS df, CASE WHEN h = 0 OR h = n THEN 0.0 ELSE
         list_sum(list_transform(range(1, r + 1), lambda i:
           pow(gn[i] - gh[i] - gn[i] * (n - h) / n, 2) / (gn[i] * (n - h) / n) + pow(gh[i] - gn[i] * h / n, 2) / (gn[i] * h / n))) END AS x,
         CASE WHEN ord THEN factorial((c - 1)::INT) / factorial((r - 1)::INT) / factorial((c - r)::INT)
              ELSE list_sum(list_transform(range(0, r + 1), lambda m: pow(-1, r - m) * pow(m, c) / gamma(m + 1) / gamma(r - m + 1))) END AS ways
  FROM f{k}),
b{k} AS (
  SELECT node, p, adj_p, unnest(list_transform(groups, lambda g, i: {{'spot': i, 'cats': list_transform(g, lambda i: cats[i])}}), recursive := true)
  FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY adj_p, p) AS place
        FROM (SELECT *, least(1.0, ({_tail('x', 'df')}) * ways) AS adj_p FROM x{k}))
  WHERE place = 1 AND adj_p <= 0.05)"""


def _grown(k: int) -> str:
    """CTEs of level ``k``: ``m`` (its nodes), ``r`` (the node of every key), ``w`` (the rules of its nodes), ``h`` (their rows)."""
    before = " + ".join(f"(SELECT count(*) FROM m{i})" for i in range(1, k)) or "0"
    rule = f"{{'p': m{k}.p, 'cats': m{k}.cats}}"
    return f"""
m{k} AS (SELECT *, {before} + row_number() OVER (ORDER BY node, spot) AS id FROM b{k}),
r{k} AS (SELECT r{k - 1}.key, coalesce(m.id, r{k - 1}.node) AS node FROM r{k - 1}
  LEFT JOIN (SELECT l{k}.key, m{k}.id FROM l{k} JOIN m{k} ON l{k}.node = m{k}.node AND l{k}.p = m{k}.p AND list_contains(m{k}.cats, l{k}.c))
    AS m USING (key)),
w{k} AS (
  SELECT m{k}.id, m{k}.node AS parent, {k} AS depth, m{k}.p, m{k}.cats, m{k}.adj_p,
         CASE WHEN list_contains(list_transform(w.rules, lambda r: r.p), m{k}.p)
              THEN list_transform(w.rules, lambda r: CASE WHEN r.p = m{k}.p THEN {rule} ELSE r END)
              ELSE list_append(w.rules, {rule}) END AS rules
  FROM m{k} JOIN w{k - 1} AS w ON w.id = m{k}.node),
h{k} AS (SELECT r{k}.node AS id, count(*) AS n, avg(hit) AS rate FROM t JOIN r{k} USING (key) WHERE r{k}.node IN (SELECT id FROM m{k}) GROUP BY 1)"""


def tree_sql(
    source: str, key: str, hit: str, numeric: dict[str, str], named: dict[str, str], min_leaf: int = 30,
    alpha: float = 0.05, alpha_resplit: float = 0.049, depth: int = 2,
) -> str:
    """CTEs ``nodes`` (as ``tree_frame``) and ``routed`` (key, leaf_id), for use behind WITH RECURSIVE."""
    probs = ", ".join(str(i / 10) for i in range(1, 10))
    cuts = ", ".join(f"list_sort(list_distinct(quantile_cont({p}::DOUBLE, [{probs}]))) AS {p}_cuts" for p in numeric)
    raw = ", ".join(f"{sql} AS {p}" for p, sql in {**numeric, **named}.items())
    bins = {p: f"'b' || lpad(len(list_filter({p}_cuts, lambda v: {p} >= v))::VARCHAR, 2, '0')" for p in numeric}
    cells = " UNION ALL ".join(
        f"SELECT key, hit, 0 AS node, '{p}' AS p, {bins.get(p, p)} AS c FROM t, q" for p in {**numeric, **named}
    )
    levels = []
    for k in range(1, depth + 1):
        if k > 1:
            levels.append(
                f"\nl{k} AS (SELECT l1.key, hit, r{k - 1}.node, p, c FROM l1 JOIN r{k - 1} USING (key) "
                f"WHERE r{k - 1}.node IN (SELECT id FROM m{k - 1}))"
            )
        levels += [_level(k, min_leaf, alpha, alpha_resplit, list(numeric)), _grown(k)]
    every = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(depth + 1))
    held = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(depth + 1))
    return f"""
t AS (SELECT {key} AS key, ({hit})::INT AS hit, {raw} FROM {source}),
q AS (SELECT {cuts} FROM t),
l1 AS ({cells}),
r0 AS (SELECT DISTINCT key, 0 AS node FROM l1),
w0 AS (SELECT 0 AS id, NULL::BIGINT AS parent, 0 AS depth, NULL::VARCHAR AS p, []::VARCHAR[] AS cats, NULL::DOUBLE AS adj_p,
       []::STRUCT(p VARCHAR, cats VARCHAR[])[] AS rules),
h0 AS (SELECT 0 AS id, count(*) AS n, avg(hit) AS rate FROM t),{','.join(levels)},
routed AS (SELECT key, node::INT AS leaf_id FROM r{depth}),
every AS ({every}),
nodes AS (
  SELECT every.id::INT AS node_id, parent::INT AS parent_id, depth, coalesce(nullif(array_to_string(list_transform(rules,
           lambda r: r.p || ' in {{' || array_to_string(r.cats, ', ') || '}}'), ' & '), ''), 'all') AS path,
         p AS split_column, array_to_string(cats, ', ') AS categories, n, rate, adj_p,
         every.id NOT IN (SELECT parent FROM every WHERE parent IS NOT NULL) AS leaf
  FROM every JOIN ({held}) AS held USING (id))"""
