"""The same results in plain SQL, written for DuckDB."""

from __future__ import annotations

METHODS = {
    "raw": (False, False, False), "norm": (False, False, True), "fill": (False, True, False),
    "remove": (True, False, False), "remove_fill": (True, True, False), "remove_norm": (True, False, True),
    "fill_norm": (False, True, True), "all": (True, True, True),
}
#: Folders of the repaired files.
SUFFIXES = {
    "norm": "1_norm", "fill": "2_fill", "remove": "3_remove", "remove_fill": "4_remove_fill", "remove_norm": "5_remove_norm",
    "fill_norm": "6_fill_norm", "all": "7_all",
}
PROFILES = {
    "A": (1000, "[25.0, 50.0, 100.0, -25.0]", 10, 0),
    "B": (5000, "[20.0, 40.0, 80.0, -20.0]", 8, 50),
}
ORDERS_SRC = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey, o_orderpriority FROM orders"
DOCS_SRC = "SELECT d.doc_id, n_chars, lang, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def r6(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def damaged(
    source: str, key: str, keep: list[str], continuous: list[str], categorical: dict[str, str],
    variants: list[tuple[int, int]], profile: str, steps: str = "mon",
) -> str:
    """CTEs ending in ``dirty``: rows of all variants, with damage_level and damage_repeat."""
    base, factors, scale, floor = PROFILES[profile]
    values = ", ".join(f"({lv}, {rp}, {base + 100 * rp + lv})" for lv, rp in variants)
    columns = [*continuous, *categorical]
    part = "PARTITION BY damage_level, damage_repeat"

    def md5(step: str, c: str) -> str:
        return f"md5(concat_ws(':', seed, '{step}', '{c}', {key}))"

    blank = [
        f"row_number() OVER ({part} ORDER BY {md5('missing', c)}) <= (count(*) OVER ({part})) * damage_level // 100 AS gone_{c}"
        if "m" in steps else f"false AS gone_{c}"
        for c in columns
    ]
    left = [
        f"CASE WHEN NOT gone_{c} THEN CAST({c} AS {'DOUBLE' if c in continuous else categorical[c]}) END AS {c}"
        for c in columns
    ]
    share = f"greatest({floor}, {scale} * damage_level)"
    hit = []
    for c in columns:
        step = "outlier" if c in continuous else "noise"
        on = ("o" if c in continuous else "n") in steps
        hit.append(
            f"({c} IS NOT NULL AND row_number() OVER ({part}, {c} IS NULL ORDER BY {md5(step, c)}) <= "
            f"greatest(1, (count({c}) OVER ({part})) * {share} // 1000)) AS hit_{c}"
            if on else f"false AS hit_{c}"
        )
    out = []
    for c in columns:
        if c in continuous:
            draw = f"CAST(('0x' || substr({md5('outlier', c)}, 26, 7)) AS BIGINT) % 4 + 1"
            out.append(f"CASE WHEN hit_{c} THEN {c} * CAST({factors}[{draw}] AS DOUBLE) ELSE {c} END AS {c}")
        else:
            out.append(f"CASE WHEN hit_{c} THEN CAST('9' AS {categorical[c]}) ELSE {c} END AS {c}")
    kept = ", ".join(keep)
    return f"""
    src AS ({source}),
    variant(damage_level, damage_repeat, seed) AS (VALUES {values}),
    grid AS (SELECT * FROM src CROSS JOIN variant),
    blanks AS (SELECT *, {', '.join(blank)} FROM grid),
    remaining AS (SELECT damage_level, damage_repeat, seed, {kept}, {', '.join(left)} FROM blanks),
    struck AS (SELECT *, {', '.join(hit)} FROM remaining),
    dirty AS (SELECT damage_level, damage_repeat, {kept}, {', '.join(out)} FROM struck)"""


def damaged_orders(variants=((20, 1),), profile="A", steps="mon") -> str:
    return damaged(
        ORDERS_SRC, "o_orderkey", ["o_orderkey", "o_orderstatus"], ["o_totalprice"],
        {"o_custkey": "BIGINT", "o_orderpriority": "VARCHAR"}, list(variants), profile, steps,
    )


def damaged_customers(variants, profile) -> str:
    return damaged(
        "SELECT * FROM customer", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"], ["c_acctbal"],
        {"c_nationkey": "INTEGER"}, list(variants), profile,
    )


ORDER_COLUMNS = f"damage_level, damage_repeat, o_orderkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice, o_custkey, o_orderpriority"


def order_rows(variants=((20, 1),), profile="A", steps="mon") -> str:
    return f"WITH {damaged_orders(variants, profile, steps)} SELECT {ORDER_COLUMNS} FROM dirty"


def cleaned(
    keys: list[str], train: str, apply: str, numeric: list[str], categorical: list[str], method: str, prefix: str = "",
) -> str:
    """CTEs that fit ``method`` on table ``train`` per keys and end in ``<prefix>clean``:
    the rows of ``apply`` with cleaned (not encoded) columns under their own names."""
    remove, fill, norm = METHODS[method]
    by = ", ".join(keys) if keys else "1"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    head = f"{', '.join(keys)}, " if keys else ""
    using = f"USING ({', '.join(keys)})" if keys else "ON true"
    bounds, p = [], prefix
    for c in numeric:
        q1, q3 = f"quantile_cont(CAST({c} AS DOUBLE), 0.25)", f"quantile_cont(CAST({c} AS DOUBLE), 0.75)"
        ok = f"count(DISTINCT {c}) >= 10 AND {q3} - {q1} <> 0"
        bounds.append(f"CASE WHEN {ok} THEN {q1} - 3.0 * ({q3} - {q1}) END AS lo_{c}")
        bounds.append(f"CASE WHEN {ok} THEN {q3} + 3.0 * ({q3} - {q1}) END AS hi_{c}")
    ctes = [f"{p}bounds AS (SELECT {head}{', '.join(bounds) or '1 AS one'} FROM {train} {group})"]
    for i, c in enumerate(categorical):
        ctes.append(
            f"{p}counts{i} AS (SELECT {head}{c} AS value, count(*) AS n, "
            f"count(*) / CAST(sum(count(*)) OVER (PARTITION BY {by}) AS DOUBLE) AS share "
            f"FROM {train} WHERE {c} IS NOT NULL GROUP BY {head}{c})"
        )
        ctes.append(
            f"{p}cat{i} AS (SELECT {head}arg_min(value, (-n, value)) AS mode_{i}, "
            f"coalesce(list(value) FILTER (WHERE share >= 0.05), []) AS valid_{i} FROM {p}counts{i} {group})"
        )

    def nulled(source: str, name: str) -> str:
        columns = []
        for c in numeric:
            v = f"CAST({c} AS DOUBLE)"
            columns.append(
                f"CASE WHEN {v} < lo_{c} OR {v} > hi_{c} THEN NULL ELSE {v} END AS {c}" if remove else f"{v} AS {c}"
            )
        for i, c in enumerate(categorical):
            columns.append(
                f"CASE WHEN len(valid_{i}) = 0 OR list_contains(valid_{i}, {c}) THEN {c} END AS {c}" if remove else c
            )
        joins = f"JOIN {p}bounds {using}" if remove else ""
        joins += "".join(f" JOIN {p}cat{i} {using}" for i in range(len(categorical)))
        excluded = ", ".join([*numeric, *categorical])
        modes = "".join(f", mode_{i}" for i in range(len(categorical)))
        return f"{name} AS (SELECT t.* EXCLUDE ({excluded}){modes}, {', '.join(columns)} FROM {source} t {joins})"

    ctes += [nulled(train, f"{p}kept"), nulled(apply, f"{p}target")]
    if numeric:
        medians = ", ".join(f"coalesce(median({c}), 0.0) AS med_{c}" for c in numeric)
        ctes.append(f"{p}medians AS (SELECT {head}{medians} FROM {p}kept {group})")

    def filled(c: str) -> str:
        return f"coalesce({c}, med_{c})" if fill else f"coalesce({c}, -999.0)"

    moments = ", ".join(
        f"avg({filled(c)}) AS mean_{c}, CASE WHEN stddev_pop({filled(c)}) > 0 THEN stddev_pop({filled(c)}) ELSE 1.0 END AS sd_{c}"
        for c in numeric
    )
    if norm and numeric:
        ctes.append(f"{p}moments AS (SELECT {head}{moments} FROM {p}kept JOIN {p}medians {using} {group})")
    columns = []
    for c in numeric:
        columns.append(f"({filled(c)} - mean_{c}) / sd_{c} AS {c}" if norm else f"{filled(c)} AS {c}")
    for i, c in enumerate(categorical):
        columns.append(f"coalesce({c}, {f'mode_{i}' if fill else repr('MISSING')}) AS {c}")
    joins = f"JOIN {p}medians {using}" if numeric else ""
    if norm and numeric:
        joins += f" JOIN {p}moments {using}"
    excluded = ", ".join([*numeric, *categorical, *[f"mode_{i}" for i in range(len(categorical))]])
    ctes.append(f"{p}clean AS (SELECT t.* EXCLUDE ({excluded}), {', '.join(columns)} FROM {p}target t {joins})")
    return ", ".join(ctes)


def hot(column: str, values, prefix: str = "cat__", kind: str = "DOUBLE") -> str:
    return ", ".join(
        f"CAST(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS {kind}) AS \"{prefix}{column}_{v}\"" for v in values
    )


NUMS, CATS = ["o_totalprice", "o_custkey"], ["o_orderpriority"]


def order_clean(method: str, select: str) -> str:
    return (
        f"WITH {damaged_orders()}, {cleaned([], 'dirty', 'dirty', NUMS, CATS, method)} SELECT {select} FROM clean"
    )


def order_matrix(method: str) -> str:
    """Every priority, the noise value and missing cells are frequent at this level of damage."""
    _, fill, _ = METHODS[method]
    values = [*PRIORITIES, "9", *([] if fill else ["MISSING"])]
    nums = ", ".join(f"{r6(c)} AS num__{c}" for c in NUMS)
    return order_clean(method, f"o_orderkey, o_orderstatus, {nums}, {hot('o_orderpriority', values)}")


def repair_by_variant() -> str:
    keys = ["damage_level", "damage_repeat"]
    nums = ", ".join(f"{r6(c)} AS num__{c}" for c in NUMS)
    return f"""WITH {damaged_orders(((20, 1), (40, 2)))}, {cleaned(keys, 'dirty', 'dirty', NUMS, CATS, 'all')}
    SELECT damage_level, damage_repeat, o_orderkey, o_orderstatus, {nums},
      {hot('o_orderpriority', [*PRIORITIES, '9'])} FROM clean"""


def folded(source: str, key: str, label: str, folds: int, seeds) -> str:
    """CTE ``folds``: fold of each key and seed."""
    values = ", ".join(f"({i}, {s})" for i, s in enumerate(seeds, start=1))
    digest = f"md5(concat_ws(':', cv_seed, 'fold', {key}))"
    return f"""seeds(cv_repeat, cv_seed) AS (VALUES {values}),
    folds AS (SELECT cv_repeat, cv_seed, {key}, CAST((row_number() OVER (PARTITION BY cv_seed, {label}
      ORDER BY {digest}) - 1) * {folds} // (count(*) OVER (PARTITION BY cv_seed, {label})) AS INTEGER) AS fold
      FROM ({source}) CROSS JOIN seeds)"""


FOLD_KEYS = ["damage_level", "damage_repeat", "cv_repeat", "cv_seed", "held_out"]
ORDERS_BINARY = (
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus, o_totalprice, o_custkey, "
    "o_orderpriority FROM orders"
)


def by_fold(damage: str, source: str, key: str, label: str, features: str, folds: int, seeds) -> str:
    """CTEs ``train`` and ``test``: rows of the clean and damaged tables per seed and held-out fold."""
    return f"""{damage}, {folded(source, key, label, folds, seeds)},
    every AS (SELECT 0 AS damage_level, 0 AS damage_repeat, {key}, {label}, {features} FROM src
      UNION ALL SELECT damage_level, damage_repeat, {key}, {label}, {features} FROM dirty),
    held AS (SELECT e.*, cv_repeat, cv_seed, fold, CAST(h.range AS INTEGER) AS held_out
      FROM every e JOIN folds USING ({key}) CROSS JOIN range({folds}) h),
    train AS (SELECT * EXCLUDE (fold) FROM held WHERE fold <> held_out),
    test AS (SELECT * EXCLUDE (fold) FROM held WHERE fold = held_out)"""


def orders_by_fold() -> str:
    damage = damaged(
        ORDERS_BINARY, "o_orderkey", ["o_orderkey", "o_orderstatus"], ["o_totalprice"],
        {"o_custkey": "BIGINT", "o_orderpriority": "VARCHAR"}, [(20, 1)], "A",
    )
    return by_fold(
        damage, ORDERS_BINARY, "o_orderkey", "o_orderstatus", "o_totalprice, o_custkey, o_orderpriority", 3, [101]
    )


def fold_stats() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {', '.join(FOLD_KEYS)}, '{c}' AS \"column\", {r6(f'lo_{c}')} AS lower, {r6(f'hi_{c}')} AS upper "
        f"FROM bounds WHERE lo_{c} IS NOT NULL"
        for c in NUMS
    )
    return f"WITH {orders_by_fold()}, {cleaned(FOLD_KEYS, 'train', 'test', NUMS, CATS, 'remove')} {parts}"


def clean_by_fold() -> str:
    nums = ", ".join(f"{r6(c)} AS num__{c}" for c in NUMS)
    return f"""WITH {orders_by_fold()}, {cleaned(FOLD_KEYS, 'train', 'test', NUMS, CATS, 'all')}
    SELECT damage_level, damage_repeat, cv_seed, held_out, o_orderkey, {nums} FROM clean"""


def naive_bayes(
    keys: list[str], train: str, test: str, ids: list[str], numeric: list[str], categorical: list[str], p: str = ""
) -> str:
    """CTE ``<p>scored``: long-form Gaussian naive Bayes over explicit one-hot cells.

    ``train`` and ``test`` have a ``label``, and ``ids`` name a row within the keys.
    """
    k = f"{', '.join(keys)}, " if keys else ""
    using = f"USING ({', '.join(keys)})" if keys else "ON true"

    def using_with(*more: str) -> str:
        return f"USING ({', '.join([*keys, *more])})"

    ids_ = ", ".join(ids)
    numeric_cells = " UNION ALL ".join(
        f"SELECT {k}{ids_}, label, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {{}}" for c in numeric
    )

    def hot_cells(table: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {k}{ids_}, label, v.feature, CASE WHEN v.value = t.{c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x "
            f"FROM {table} t JOIN {p}vocab{i} v {using}"
            for i, c in enumerate(categorical)
        )

    cat = "contains(feature, '=')"
    vocab = ", ".join(
        f"{p}vocab{i} AS (SELECT DISTINCT {k}{c} AS value, '{c}=' || {c} AS feature FROM {train})"
        for i, c in enumerate(categorical)
    )
    cells = {
        t: numeric_cells.replace("{}", t) + (" UNION ALL " + hot_cells(t) if categorical else "") for t in (train, test)
    }
    return f"""{vocab + ',' if vocab else ''}
    {p}train_cells AS ({cells[train]}),
    {p}test_cells AS ({cells[test]}),
    {p}means AS (SELECT {k}feature, avg(x) FILTER (WHERE label = 0) AS m0, avg(x) FILTER (WHERE label = 1) AS m1,
      var_pop(x) FILTER (WHERE label = 0) AS w0, var_pop(x) FILTER (WHERE label = 1) AS w1, var_pop(x) AS w, avg(x) AS m
      FROM {p}train_cells GROUP BY {k}feature),
    {p}stats AS (SELECT {k}feature, m0, m1, CASE WHEN {cat} THEN m0 * (1 - m0) ELSE w0 END AS v0,
      CASE WHEN {cat} THEN m1 * (1 - m1) ELSE w1 END AS v1, CASE WHEN {cat} THEN m * (1 - m) ELSE w END AS v
      FROM {p}means),
    {p}smooth AS (SELECT {k}max(v) * 1e-9 AS s FROM {p}stats {f"GROUP BY {', '.join(keys)}" if keys else ""}),
    {p}prior AS (SELECT {k}ln(count(*) FILTER (WHERE label = 1)) - ln(count(*) FILTER (WHERE label = 0)) AS prior
      FROM {train} {f"GROUP BY {', '.join(keys)}" if keys else ""}),
    {p}weighed AS (SELECT *, {cat} AND v0 = 0 AND x <> m0 AS never0, {cat} AND v1 = 0 AND x <> m1 AS never1
      FROM {p}test_cells JOIN {p}stats {using_with('feature')} JOIN {p}smooth {using}),
    {p}odds AS (SELECT {k}{ids_}, any_value(label) AS label,
      CAST(sum(CAST(CASE WHEN never0 THEN 0 ELSE (x-m0)*(x-m0)/((v0+s)*2.0) END
        - CASE WHEN never1 THEN 0 ELSE (x-m1)*(x-m1)/((v1+s)*2.0) END
        + (ln(v0+s)-ln(v1+s))/2.0 AS DECIMAL(38, 18))) AS DOUBLE) AS z,
      sum(CAST(never0 AS INTEGER) - CAST(never1 AS INTEGER)) / (2.0::DOUBLE * any_value(s)) AS strong
      FROM {p}weighed GROUP BY {k}{ids_}),
    {p}scored AS (SELECT {k}{ids_}, label, 1.0 / (1.0 + exp(-(z + prior + strong))) AS score FROM {p}odds JOIN {p}prior {using})"""


def doc_scores() -> str:
    """CTE ``scored`` with doc_id, label and score; ``docs_lang`` has the language."""
    return f"""WITH src AS (SELECT doc_id, n_chars, lang, source, quality AS label FROM ({DOCS_SRC})),
    {cleaned([], 'src', 'src', ['n_chars'], ['lang', 'source'], 'fill_norm')},
    {naive_bayes([], 'clean', 'clean', ['doc_id'], ['n_chars'], ['lang', 'source'])},
    final AS (SELECT s.doc_id, c.lang, s.label AS quality, score FROM scored s JOIN clean c ON s.doc_id = c.doc_id)"""


def auc_sql(source: str, keys: list[str], label: str = "label", score: str = "score") -> str:
    """SELECT of keys, n_pos, n_neg and auc by average ranks."""
    k = f"{', '.join(keys)}, " if keys else ""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    tie = f"PARTITION BY {k}{score}"
    return f"""SELECT {k}CAST(sum({label}) AS BIGINT) AS n_pos, CAST(count(*) - sum({label}) AS BIGINT) AS n_neg,
      (sum(r) FILTER (WHERE {label} = 1) - sum({label}) * (sum({label}) + 1) / 2.0)
        / nullif(CAST(sum({label}) AS DOUBLE) * (count(*) - sum({label})), 0) AS auc
      FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({tie}) - 1) / 2.0 AS r FROM {source})
      {f"GROUP BY {', '.join(keys)}" if keys else ""}"""


NB_METHODS = ("raw", "fill", "remove", "all")
FAST_METHODS = ("raw", "fill", "remove_fill", "fill_norm", "all")
FULL_VARIANTS = tuple((level, repeat) for level in (20, 40, 60) for repeat in (1, 2, 3, 4, 5))
B_VARIANTS = tuple((level, repeat) for level in (10, 20, 30, 40, 50) for repeat in (1, 2, 3))
FAST_VARIANTS = tuple((level, repeat) for level in (20, 40, 60) for repeat in (1, 2))


def corners(source: str, keys: list[str]) -> str:
    """SELECT of the curve's corners: where the next lower score's step has another direction."""
    k = f"{', '.join(keys)}, " if keys else ""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {k}{r6('score')} AS threshold, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM (
        SELECT *, sum(neg) OVER w / CAST(sum(neg) OVER ({part}) AS DOUBLE) AS fpr,
          sum(pos) OVER w / CAST(sum(pos) OVER ({part}) AS DOUBLE) AS tpr,
          coalesce(pos * lead(neg) OVER w = neg * lead(pos) OVER w, false) AS straight
        FROM (SELECT {k}score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
          FROM {source} GROUP BY {k}score) WINDOW w AS ({part} ORDER BY score DESC)) WHERE NOT straight
      UNION ALL SELECT DISTINCT {k}CAST('infinity' AS DOUBLE), 0.0, 0.0 FROM {source}"""


def nb_details(variants=((20, 1), (40, 2)), methods=NB_METHODS, seeds=(101, 202), folds=3, profile="A", source=DOCS_SRC, dataset="documents") -> str:
    """CTEs ending in ``details``: the naive Bayes runs of the labelled documents."""
    damage = damaged(
        source, "doc_id", ["doc_id", "quality"], ["n_chars"], {"lang": "VARCHAR", "source": "VARCHAR"},
        list(variants), profile,
    )
    keys = FOLD_KEYS
    rows = by_fold(damage, source, "doc_id", "quality", "n_chars, lang, source", folds, list(seeds))
    parts, aucs = [], []
    for m in methods:
        only = "" if m == "raw" else " WHERE damage_level > 0"
        parts.append(f"{m}_train AS (SELECT * EXCLUDE (quality), quality AS label, true AS tr FROM train{only})")
        parts.append(f"{m}_all AS (SELECT * FROM {m}_train UNION ALL SELECT * EXCLUDE (quality), quality, false FROM test{only})")
        parts.append(cleaned(keys, f"{m}_train", f"{m}_all", ["n_chars"], ["lang", "source"], m, f"{m}_"))
        parts.append(f"{m}_ctrain AS (SELECT * FROM {m}_clean WHERE tr), {m}_ctest AS (SELECT * FROM {m}_clean WHERE NOT tr)")
        parts.append(naive_bayes(keys, f"{m}_ctrain", f"{m}_ctest", ["doc_id"], ["n_chars"], ["lang", "source"], f"{m}_"))
        aucs.append(f"SELECT '{m}' AS method, * FROM ({auc_sql(f'{m}_scored', keys)})")
    return f"""WITH {rows}, {', '.join(parts)}, aucs AS ({' UNION ALL '.join(aucs)}),
    details AS (SELECT '{dataset}' AS dataset,
      CASE WHEN damage_level = 0 THEN 'ORYGINALNY' ELSE damage_level || '%' END AS damage_level,
      method, 'NB' AS model, damage_repeat, cv_repeat, cv_seed, round(avg(auc), 4) AS auc
      FROM aucs GROUP BY ALL)"""


def summary_sql(source: str, digits: int) -> str:
    return f"""SELECT dataset, damage_level, method, model, round(avg(auc), {digits}) AS auc_mean,
      round(coalesce(stddev_samp(auc), 0.0), {digits}) AS auc_std, count(auc) AS n_runs
      FROM {source} GROUP BY dataset, damage_level, method, model"""


def delta_sql(source: str, digits: int) -> str:
    return f"""SELECT s.*, b.auc_mean AS auc_baseline, round(s.auc_mean - b.auc_mean, {digits}) AS auc_delta
      FROM {source} s LEFT JOIN (SELECT dataset, model, auc_mean FROM {source} WHERE damage_level = 'ORYGINALNY') b
      ON s.dataset = b.dataset AND s.model = b.model"""


RUNS = f"""runs AS (SELECT l_returnflag AS dataset,
    CASE WHEN l_linenumber = 1 THEN 'ORYGINALNY' ELSE ((l_linenumber - 1) * 10) || '%' END AS damage_level,
    CASE WHEN l_linenumber = 1 THEN 'raw' WHEN l_linestatus = 'O' THEN 'fill' ELSE 'all' END AS method,
    (['NB', 'MLP', 'XGBoost', 'RF', 'OTHER'])[l_suppkey % 5 + 1] AS model, 0.5 + l_quantity / 200.0 AS auc
    FROM lineitem), summed AS ({summary_sql('runs', 6)})"""
KNOWN = "('NB', 'MLP', 'XGBoost', 'RF')"
LEVEL_ORDER = "CASE WHEN damage_level = 'ORYGINALNY' THEN -1 ELSE CAST(replace(damage_level, '%', '') AS INTEGER) END"


def method_model_table() -> str:
    cells = ", ".join(
        f"any_value({col}) FILTER (WHERE model = '{m}') AS \"{m}_{name}\""
        for m in ("NB", "MLP", "XGBoost", "RF")
        for name, col in (("mean", "auc_mean"), ("std", "auc_std"), ("baseline", "auc_baseline"))
    )
    return f"""WITH {RUNS}, deltas AS ({delta_sql('summed', 4)})
    SELECT dataset, damage_level, method, {cells}, {LEVEL_ORDER} AS level_order FROM deltas
    WHERE damage_level <> 'ORYGINALNY' AND model IN {KNOWN} GROUP BY dataset, damage_level, method"""


BOX = """box AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
    marked AS (SELECT e.event_type, value, q1, median, q3,
      value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS beyond
      FROM events e JOIN box b ON e.event_type = b.event_type)"""
DISCOUNT_SCORES = """SELECT l_linestatus, l_quantity / 50.0 AS score,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem"""


VALUES = """v AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events),
    f AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1,
      quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY event_type),
    w AS (SELECT v.*, m, sd, q1, q2, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high
      FROM v LEFT JOIN f ON v.event_type IS NOT DISTINCT FROM f.event_type)"""
RANKED = """r AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice ELSE CAST('-infinity' AS DOUBLE) END
    AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)"""


_MISSING = "CASE WHEN l_orderkey % 5 = 0 OR l_orderkey % 7 = 0 THEN {} ELSE {} END"
#: Missing scores rank below all others; keys may be NULL.
GAPS = f"""SELECT CASE WHEN l_suppkey % 4 <> 0 THEN l_returnflag END AS flag,
    {_MISSING.format("CAST('-infinity' AS DOUBLE)", "l_quantity / 50.0")} AS score,
    {_MISSING.format("NULL", "l_quantity / 50.0")} AS number, {_MISSING.format("NULL", "l_extendedprice")} AS price,
    CASE WHEN l_partkey % 6 <> 0 THEN l_linestatus END AS status,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label FROM lineitem"""


def thresholds(source: str, keys: list[str]) -> str:
    """CTE ``steps``: recalls and accuracy of thresholds 0.01 .. 0.98."""
    k = f"{', '.join(keys)}, " if keys else ""
    return f"""tried AS (SELECT {k}CAST(range AS INTEGER) AS step, range / 100.0 AS threshold,
      count(*) FILTER (WHERE label = 0 AND NOT score > range / 100.0) / nullif(count(*) FILTER (WHERE label = 0), 0)::DOUBLE AS r0,
      count(*) FILTER (WHERE label = 1 AND score > range / 100.0) / nullif(count(*) FILTER (WHERE label = 1), 0)::DOUBLE AS r1,
      count(*) FILTER (WHERE (label = 1) = (score > range / 100.0)) / count(*)::DOUBLE AS accuracy
      FROM {source} CROSS JOIN range(1, 99) GROUP BY {k}range),
    steps AS (SELECT {k}step, threshold, coalesce(r0, 0) AS recall0, coalesce(r1, 0) AS recall1, accuracy,
      abs(coalesce(r0, 0) - coalesce(r1, 0)) AS diff FROM tried)"""


def threshold_report(source: str = DISCOUNT_SCORES, key: str = "l_linestatus") -> str:
    lines = {
        "0": ("p0", "rc0", "f0", "s0"), "1": ("p1", "rc1", "f1", "s1"),
        "accuracy": ("NULL", "NULL", "acc", "s0 + s1"),
        "macro avg": ("(p0 + p1) / 2", "(rc0 + rc1) / 2", "(f0 + f1) / 2", "s0 + s1"),
        "weighted avg": (
            "(p0 * s0 + p1 * s1) / (s0 + s1)", "(rc0 * s0 + rc1 * s1) / (s0 + s1)", "(f0 * s0 + f1 * s1) / (s0 + s1)",
            "s0 + s1",
        ),
    }
    union = " UNION ALL ".join(
        f"SELECT {key}, '{n}' AS class, {r6(f'CAST({a} AS DOUBLE)')} AS precision, "
        f"{r6(f'CAST({b} AS DOUBLE)')} AS recall, {r6(c)} AS f1, {d} AS support FROM rated"
        for n, (a, b, c, d) in lines.items()
    )
    return f"""WITH c AS (SELECT {key}, count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp,
      count(*) FILTER (WHERE label = 0 AND score > 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score <= 0.5) AS fn,
      count(*) FILTER (WHERE label = 0 AND score <= 0.5) AS tn FROM ({source}) GROUP BY {key}),
    rated AS (SELECT {key}, tn + fp AS s0, tp + fn AS s1,
      coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) AS p0, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p1,
      coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS rc0, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS rc1,
      coalesce(2 * tn / nullif(2 * tn + fn + fp, 0)::DOUBLE, 0) AS f0,
      coalesce(2 * tp / nullif(2 * tp + fn + fp, 0)::DOUBLE, 0) AS f1, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS acc
      FROM c) {union}"""


def grid() -> str:
    methods = "['raw', 'fill', 'remove_fill', 'fill_norm', 'all']"
    return f"""WITH d AS (SELECT DISTINCT source AS dataset FROM documents)
    SELECT dataset, 'ORYGINALNY' AS damage_level, 'raw' AS method, model, 0 AS damage_repeat
    FROM d CROSS JOIN unnest(['RF', 'NB', 'XGBoost']) m(model)
    UNION ALL
    SELECT dataset, level || '%', method, model, CAST(damage_repeat AS INTEGER) FROM d
    CROSS JOIN unnest([20, 40, 60]) l(level) CROSS JOIN unnest([1, 2]) r(damage_repeat)
    CROSS JOIN unnest({methods}) x(method) CROSS JOIN unnest(['RF', 'NB', 'XGBoost']) m(model)"""


RESOLVE = """WITH stored AS (SELECT l_returnflag AS dataset, CAST(l_linenumber * 10 AS INTEGER) AS damage_level,
      CAST(l_suppkey % 7 AS INTEGER) AS slot, count(*) AS n FROM lineitem GROUP BY ALL),
    catalog AS (SELECT dataset, damage_level, slot, dataset || '/' || damage_level || '/' || slot AS location
      FROM stored WHERE (n + slot) % 3 <> 0 AND slot <= 5),
    joined AS (SELECT w.dataset, w.damage_level, w.slot AS r, o.location AS own, s.location AS spare
      FROM stored w
      LEFT JOIN catalog o ON w.dataset = o.dataset AND w.damage_level = o.damage_level AND w.slot = o.slot
      LEFT JOIN catalog s ON w.dataset = s.dataset AND w.damage_level = s.damage_level AND s.slot = 0
      WHERE w.slot BETWEEN 1 AND 5)
    SELECT dataset, damage_level, CASE WHEN own IS NULL THEN 1 ELSE r END AS damage_repeat,
      coalesce(own, spare) AS location FROM joined j
    WHERE coalesce(own, spare) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM joined e WHERE e.dataset = j.dataset
      AND e.damage_level = j.damage_level AND e.own IS NULL AND e.spare IS NOT NULL AND e.r < j.r)"""


def rare(min_frequency: float) -> str:
    """CTE ``ok``: frequent values of both part columns."""
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share "
        f"FROM part WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("p_brand", "p_type")
    )
    return f"ok AS (SELECT \"column\", value FROM ({counts}) WHERE share >= {min_frequency})"


def rare_to_null(min_frequency: float) -> str:
    columns = ", ".join(
        f"CASE WHEN {c} IN (SELECT value FROM ok WHERE \"column\" = '{c}') "
        f"OR NOT EXISTS (SELECT 1 FROM ok WHERE \"column\" = '{c}') THEN {c} END AS {c}"
        for c in ("p_brand", "p_type")
    )
    return f"WITH {rare(min_frequency)} SELECT p_partkey, {columns} FROM part"


def bound(kind: str, c: str) -> str:
    q1, q3 = f"quantile_cont(CAST({c} AS DOUBLE), 0.25)", f"quantile_cont(CAST({c} AS DOUBLE), 0.75)"
    return f"{q1} - 3.0 * ({q3} - {q1})" if kind == "lower" else f"{q3} + 3.0 * ({q3} - {q1})"


def iqr_bounds() -> str:
    return " UNION ALL ".join(
        f"SELECT event_type, '{c}' AS \"column\", {r6(bound('lower', c))} AS lower, {r6(bound('upper', c))} AS upper "
        f"FROM events GROUP BY event_type HAVING count(DISTINCT {c}) >= 10 "
        f"AND quantile_cont({c}, 0.75) <> quantile_cont({c}, 0.25)"
        for c in ("value", "user_id")
    )


A_GRID = [(lv, rp) for lv in (20, 40, 60) for rp in range(1, 6)]

QUARTILES = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", {r6(f'quantile_cont({c}, 0.25)')} AS q1, "
    f"{r6(f'quantile_cont({c}, 0.5)')} AS median, {r6(f'quantile_cont({c}, 0.75)')} AS q3 FROM lineitem GROUP BY l_returnflag"
    for c in ("l_extendedprice", "l_quantity")
)

ORACLE: dict[str, str] = {
    "iqr_bounds": iqr_bounds(),
    "outlier_to_null": f"""WITH b AS (SELECT {bound('lower', 'value')} AS lo, {bound('upper', 'value')} AS hi FROM events)
        SELECT event_id, event_type, CASE WHEN value >= lo AND value <= hi THEN value END AS value FROM events, b""",
    "rare_categories": f"WITH {rare(0.04)} SELECT * FROM ok",
    "rare_to_null": rare_to_null(0.04),
    "rare_all_invalid": rare_to_null(0.05),
    "relative_frequency": f"""SELECT o_orderstatus, 'o_orderpriority' AS "column", value, n, total,
        {r6('n / CAST(total AS DOUBLE)')} AS share FROM (SELECT o_orderstatus, o_orderpriority AS value, count(*) AS n,
        CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total FROM orders
        GROUP BY o_orderstatus, o_orderpriority)""",
    "distinct_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")
    ),
    "quantiles": QUARTILES,
    "inject_missing": order_rows(steps="m").replace(r6("o_totalprice"), "o_totalprice"),
    "inject_outliers_a": order_rows(steps="o"),
    "inject_outliers_b": order_rows(((10, 1),), "B", "o"),
    "inject_noise_a": order_rows(steps="n").replace(r6("o_totalprice"), "o_totalprice"),
    "inject_noise_b": order_rows(((10, 1),), "B", "n").replace(r6("o_totalprice"), "o_totalprice"),
    "dirty_variant": order_rows(),
    "dirty_variant_b": order_rows(((50, 3),), "B"),
    "variant_grid": f"""WITH {damaged_customers(A_GRID, 'A')} SELECT damage_level, damage_repeat, count(*) AS n_rows,
        count(c_acctbal) AS n_acctbal, {r6('sum(c_acctbal)', 2)} AS sum_acctbal, count(c_nationkey) AS n_nationkey,
        CAST(sum(c_nationkey) AS BIGINT) AS sum_nationkey FROM dirty GROUP BY damage_level, damage_repeat""",
    "stored_variant_grid": f"""WITH {damaged_customers(A_GRID, 'A')} SELECT damage_level, damage_repeat, count(*) AS n_rows,
        count(c_acctbal) AS n_acctbal, {r6('sum(c_acctbal)', 2)} AS sum_acctbal, count(c_nationkey) AS n_nationkey,
        CAST(sum(c_nationkey) AS BIGINT) AS sum_nationkey FROM dirty GROUP BY damage_level, damage_repeat""",
    "variant_round_trip": f"""WITH {damaged_customers([(10, 1), (50, 2)], 'B')} SELECT damage_level, damage_repeat,
        count(*) AS n_rows, count(c_acctbal) AS n_acctbal, {r6('sum(c_acctbal)', 2)} AS sum_acctbal,
        CAST(sum(c_nationkey) AS BIGINT) AS sum_nationkey FROM dirty GROUP BY damage_level, damage_repeat""",
    "impute_constant": order_clean(
        "raw", f"o_orderkey, {r6('o_totalprice')} AS o_totalprice, {r6('o_custkey')} AS o_custkey, o_orderpriority"
    ),
    "impute_median": order_clean("fill", f"o_orderkey, {r6('o_totalprice')} AS o_totalprice, {r6('o_custkey')} AS o_custkey"),
    "impute_mode": order_clean("fill", "o_orderkey, o_orderpriority"),
    "standardise": order_clean(
        "fill_norm", f"o_orderkey, {r6('o_totalprice')} AS o_totalprice, {r6('o_custkey')} AS o_custkey"
    ),
    "one_hot": order_clean("fill", f"o_orderkey, {hot('o_orderpriority', [*PRIORITIES, '9'])}"),
    "one_hot_long": """SELECT p_partkey, 'cat__p_brand_' || p_brand AS feature, 1.0::DOUBLE AS value FROM part
        WHERE p_brand IS NOT NULL UNION ALL
        SELECT p_partkey, 'cat__p_type_' || p_type, 1.0::DOUBLE FROM part WHERE p_type IS NOT NULL""",
    "minmax": f"WITH {damaged_orders()} SELECT o_orderkey, " + ", ".join(
        r6(f"(CAST({c} AS DOUBLE) - min({c}) OVER ()) / nullif(CAST(max({c}) OVER () - min({c}) OVER () AS DOUBLE), 0)")
        + f" AS {c}" for c in NUMS
    ) + " FROM dirty",
    "dummies": f"SELECT o_orderkey, {hot('o_orderpriority', PRIORITIES, '', 'INTEGER')} FROM orders",
    "dummies_drop_first": f"SELECT o_orderkey, {hot('o_orderpriority', PRIORITIES[1:], '', 'INTEGER')} FROM orders",
    "repair_by_variant": repair_by_variant(),
    "repaired_files": f"""WITH {damaged_customers([(20, 1), (60, 5)], 'A')},
        {cleaned(['damage_level', 'damage_repeat'], 'dirty', 'dirty', ['c_acctbal', 'c_nationkey'], [], 'remove_fill')}
        SELECT damage_level, damage_repeat, count(*) AS n_rows, {r6('sum(c_acctbal)', 2)} AS sum_acctbal,
        {r6('sum(c_nationkey)', 2)} AS sum_nationkey FROM clean GROUP BY damage_level, damage_repeat""",
    "repaired_files_all": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {damaged_customers([(20, 1), (60, 5)], 'A')},
        {cleaned(['damage_level', 'damage_repeat'], 'dirty', 'dirty', ['c_acctbal', 'c_nationkey'], [], m)}
        SELECT damage_level, damage_repeat, '{suffix}' AS suffix, count(*) AS n_rows, {r6('sum(c_acctbal)', 2)} AS sum_acctbal,
        {r6('sum(c_nationkey)', 2)} AS sum_nationkey FROM clean GROUP BY damage_level, damage_repeat)"""
        for m, suffix in SUFFIXES.items()
    ),
    "map_target": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS o_orderstatus, o_totalprice
        FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "labelled_file": f"""SELECT CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS o_orderstatus, o_orderpriority,
        count(*) AS n, {r6('sum(o_totalprice)', 2)} AS total FROM orders WHERE o_orderstatus IN ('F', 'O')
        GROUP BY 1, 2""",
    "text_to_number": """SELECT event_id, TRY_CAST(regexp_extract(props, '"k": *([^}]*)', 1) AS DOUBLE) AS k,
        TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events""",
    "level_order": f"""WITH {RUNS} SELECT damage_level, count(*) AS n, {LEVEL_ORDER} AS level_order FROM runs
        GROUP BY damage_level""",
    "grid": grid(),
    "resolve_variant": RESOLVE,
    "stratified_folds": f"""WITH {folded('SELECT * FROM orders', 'o_orderkey', 'o_orderstatus', 5, [101, 202, 303])}
        SELECT f.*, o_orderstatus FROM folds f JOIN orders o ON f.o_orderkey = o.o_orderkey""",
    "holdout_split": """SELECT o_orderkey,
        CAST(('0x' || substr(md5(concat_ws(':', 42, 'split', o_orderkey)), 1, 7)) AS BIGINT) % 100 < 80 AS in_training
        FROM orders""",
    "fold_stats": fold_stats(),
    "clean_by_fold": clean_by_fold(),
    "nb_scores": f"{doc_scores()} SELECT doc_id, lang, quality, {r6('score')} AS score FROM final",
    "auc": f"{doc_scores()} SELECT lang, n_pos, n_neg, {r6('auc')} AS auc FROM ({auc_sql('final', ['lang'], 'quality')})",
    "auc_of_discounts": f"""WITH r AS (SELECT l_linestatus, l_discount,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem)
        SELECT l_linestatus, n_pos, n_neg, {r6('auc')} AS auc
        FROM ({auc_sql('r', ['l_linestatus'], 'returned', 'l_discount')})""",
    "quantiles_narrowed": QUARTILES,
    "roc_points": f"""WITH s AS (SELECT o_totalprice AS threshold, count(*) FILTER (WHERE o_orderstatus = 'F') AS pos,
        count(*) FILTER (WHERE o_orderstatus <> 'F') AS neg FROM orders GROUP BY o_totalprice)
        SELECT {r6('threshold')} AS threshold,
        {r6('sum(neg) OVER (ORDER BY threshold DESC) / CAST(sum(neg) OVER () AS DOUBLE)')} AS fpr,
        {r6('sum(pos) OVER (ORDER BY threshold DESC) / CAST(sum(pos) OVER () AS DOUBLE)')} AS tpr FROM s
        UNION ALL SELECT CAST('infinity' AS DOUBLE), 0.0, 0.0""",
    "zscore_outliers": f"""WITH {VALUES} SELECT event_id, event_type,
        {r6('CASE WHEN NOT coalesce(abs(value - m) > 2 * sd, false) THEN value END')} AS value FROM w""",
    "winsorise": f"""WITH {VALUES} SELECT event_id, event_type,
        {r6('CASE WHEN value IS NOT NULL THEN least(greatest(value, low), high) END')} AS value FROM w""",
    "drop_outlier_rows": f"""WITH {VALUES} SELECT event_id, event_type, {r6('value')} AS value FROM w
        WHERE NOT coalesce(value < low OR value > high, false)""",
    "impute_mean": f"WITH {VALUES} SELECT event_id, event_type, {r6('coalesce(value, m)')} AS value FROM w",
    "robust_scale": f"""WITH {VALUES} SELECT event_id, event_type,
        {r6('(value - q2) / CASE WHEN q3 <> q1 THEN q3 - q1 ELSE 1 END')} AS value FROM w""",
    "distinct_by_group": " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem GROUP BY l_returnflag"
        for c in ("l_suppkey", "l_extendedprice")
    ),
    "auc_ranges": f"""WITH {RANKED} SELECT o_orderpriority, n_pos, n_neg, {r6('auc')} AS auc
        FROM ({auc_sql('r', ['o_orderpriority'], 'label')})""",
    "roc_ranges": f"""WITH {RANKED}, s AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
        count(*) FILTER (WHERE label = 0) AS neg FROM r GROUP BY score)
        SELECT {r6('threshold')} AS threshold,
        {r6('sum(neg) OVER (ORDER BY threshold DESC) / CAST(sum(neg) OVER () AS DOUBLE)')} AS fpr,
        {r6('sum(pos) OVER (ORDER BY threshold DESC) / CAST(sum(pos) OVER () AS DOUBLE)')} AS tpr FROM s
        UNION ALL SELECT CAST('infinity' AS DOUBLE), 0.0, 0.0""",
    "dirty_keyless": """SELECT count(*) AS n_rows, count(*) - count(*) * 20 // 100 AS n_quantity,
        count(*) - count(*) * 20 // 100 AS n_price FROM lineitem""",
    "threshold_metrics": f"""{doc_scores()}, labelled AS (SELECT quality AS label, score FROM final),
        {thresholds('labelled', [])} SELECT step, {r6('threshold')} AS threshold, {r6('recall0')} AS recall0,
        {r6('recall1')} AS recall1, {r6('accuracy')} AS accuracy, {r6('diff')} AS diff FROM steps""",
    "threshold_search": f"""WITH s AS ({DISCOUNT_SCORES}), {thresholds('s', ['l_linestatus'])},
        best AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY diff, step) AS place FROM steps)
        SELECT l_linestatus, {r6('threshold')} AS threshold, {r6('recall0')} AS recall0, {r6('recall1')} AS recall1,
        {r6('accuracy')} AS accuracy FROM best WHERE place = 1""",
    "threshold_report": threshold_report(),
    "nb_cv_auc": f"{nb_details()} SELECT * FROM details",
    "nb_grid_fast": f"{nb_details(FAST_VARIANTS, FAST_METHODS)} SELECT * FROM details",
    "resumed_study": f"""SELECT * FROM ({nb_details(FAST_VARIANTS, FAST_METHODS)} {summary_sql('details', 6)})
        UNION ALL SELECT * FROM ({nb_details(FAST_VARIANTS, FAST_METHODS, source=DOCS_SRC + ' WHERE n_chars < 2000', dataset='short')}
        {summary_sql('details', 6)})""",
    "stored_stand_in": f"""WITH {damaged_customers([(20, 1), (20, 2), (40, 1)], 'A')} SELECT damage_level, damage_repeat,
        count(*) AS n_rows, count(c_acctbal) AS n_acctbal, {r6('sum(c_acctbal)', 2)} AS sum_acctbal,
        count(c_nationkey) AS n_nationkey, CAST(sum(c_nationkey) AS BIGINT) AS sum_nationkey
        FROM dirty GROUP BY damage_level, damage_repeat""",
    "roc_corners": f"WITH {RANKED} {corners('r', [])}",
    "roc_corners_gaps": f"WITH g AS ({GAPS}) {corners('g', ['flag'])}",
    "nb_grid_full": f"{nb_details(FULL_VARIANTS, tuple(METHODS), (101, 202, 303, 404, 505), 5)} SELECT * FROM details",
    "nb_grid_10_50": f"{nb_details(B_VARIANTS, FAST_METHODS, (101, 202, 303), 4, 'B')} SELECT * FROM details",
    "stored_variant_study": f"{nb_details(FAST_VARIANTS, FAST_METHODS)} SELECT * FROM details",
    "nb_study": f"{nb_details()}, summed AS ({summary_sql('details', 6)}) {delta_sql('summed', 6)}",
    "result_summary": f"WITH {RUNS} SELECT * FROM summed",
    "baseline_delta": f"WITH {RUNS} {delta_sql('summed', 5)}",
    "delta_curve": f"""WITH {RUNS}, deltas AS ({delta_sql('summed', 4)}) SELECT dataset, model, method, damage_level,
        {LEVEL_ORDER} AS level_order, (auc_delta + 0.0) AS auc_delta FROM deltas
        WHERE damage_level <> 'ORYGINALNY' AND model IN {KNOWN}""",
    "method_model_table": method_model_table(),
    "model_list": f"""WITH {RUNS} SELECT DISTINCT model,
        CAST(list_position(['NB', 'MLP', 'XGBoost', 'RF'], model) AS INTEGER) AS model_order
        FROM runs WHERE model IN {KNOWN}""",
    "level_list": f"WITH {RUNS} SELECT DISTINCT damage_level, {LEVEL_ORDER} AS level_order FROM runs",
    "distinct_values": "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL",
    "top_orders": """SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(row_number() OVER
        (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders)
        WHERE place <= 5""",
    "boxplot_stats": f"""WITH {BOX} SELECT event_type, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
        {r6('least(q1, min(value) FILTER (WHERE NOT beyond))')} AS whisker_low,
        {r6('greatest(q3, max(value) FILTER (WHERE NOT beyond))')} AS whisker_high,
        count(*) FILTER (WHERE beyond) AS n_outliers, count(value) AS n FROM marked GROUP BY event_type, q1, median, q3""",
    "boxplot_outliers": f"WITH {BOX} SELECT event_type, value FROM marked WHERE beyond",
    "result_files": f"WITH {RUNS} SELECT * FROM summed",
    "keyed_rows": "SELECT count(*) AS n_rows, count(*) AS n_keys FROM lineitem",
}
_AUC_GAPS = f"WITH g AS ({GAPS}) SELECT flag, n_pos, n_neg, {r6('auc')} AS auc FROM ({auc_sql('g', ['flag'])})"
_BOX_GAPS = """q AS (SELECT flag, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
    quantile_cont(price, 0.75) AS q3 FROM g GROUP BY flag)"""
ORACLE.update({
    "auc_gaps": _AUC_GAPS,
    "auc_gaps_ranges": _AUC_GAPS,
    "roc_gaps": f"""WITH g AS ({GAPS}), s AS (SELECT flag, score AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
        count(*) FILTER (WHERE label = 0) AS neg FROM g GROUP BY ALL)
        SELECT flag, {r6('threshold')} AS threshold,
        {r6('sum(neg) OVER (PARTITION BY flag ORDER BY threshold DESC) / CAST(sum(neg) OVER (PARTITION BY flag) AS DOUBLE)')} AS fpr,
        {r6('sum(pos) OVER (PARTITION BY flag ORDER BY threshold DESC) / CAST(sum(pos) OVER (PARTITION BY flag) AS DOUBLE)')} AS tpr
        FROM s UNION ALL SELECT flag, CAST('infinity' AS DOUBLE), CASE WHEN sum(neg) > 0 THEN 0.0 END,
        CASE WHEN sum(pos) > 0 THEN 0.0 END FROM s GROUP BY flag""",
    "threshold_metrics_gaps": f"""WITH g AS ({GAPS}), {thresholds('g', ['flag'])} SELECT flag, step,
        {r6('threshold')} AS threshold, {r6('recall0')} AS recall0, {r6('recall1')} AS recall1,
        {r6('accuracy')} AS accuracy, {r6('diff')} AS diff FROM steps""",
    "threshold_search_gaps": f"""WITH g AS ({GAPS}), {thresholds('g', ['flag'])},
        best AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY diff, step) AS place FROM steps)
        SELECT flag, CASE WHEN diff < 1 THEN {r6('threshold')} ELSE 0.0 END AS threshold,
        CASE WHEN diff < 1 THEN {r6('recall0')} ELSE 0.0 END AS recall0,
        CASE WHEN diff < 1 THEN {r6('recall1')} ELSE 0.0 END AS recall1,
        CASE WHEN diff < 1 THEN {r6('accuracy')} ELSE 0.0 END AS accuracy FROM best WHERE place = 1""",
    "threshold_report_gaps": threshold_report(GAPS, "flag"),
    "quantiles_gaps": " UNION ALL ".join(
        f"SELECT flag, '{name}' AS \"column\", " + ", ".join(f"{r6(f'quantile_cont({c}, {p})')} AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
        + f" FROM ({GAPS}) GROUP BY flag"
        for name, c in (("price", "price"), ("score", "number"))
    ),
    "boxplot_gaps": f"""WITH g AS ({GAPS}), {_BOX_GAPS}, marked AS (SELECT g.flag, price, q1, median, q3,
          price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) AS beyond
          FROM g JOIN q ON g.flag IS NOT DISTINCT FROM q.flag)
        SELECT flag, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
        {r6('least(q1, min(price) FILTER (WHERE NOT beyond))')} AS whisker_low,
        {r6('greatest(q3, max(price) FILTER (WHERE NOT beyond))')} AS whisker_high,
        count(*) FILTER (WHERE beyond) AS n_outliers, count(price) AS n FROM marked GROUP BY flag, q1, median, q3""",
    "relative_frequency_gaps": f"""WITH g AS ({GAPS}) SELECT flag, 'status' AS "column", status AS value, count(*) AS n,
        CAST(sum(count(*)) OVER (PARTITION BY flag) AS BIGINT) AS total,
        {r6('count(*) / CAST(sum(count(*)) OVER (PARTITION BY flag) AS DOUBLE)')} AS share
        FROM g WHERE status IS NOT NULL GROUP BY flag, status""",
    "clean_gaps": f"""WITH g AS ({GAPS}), {_BOX_GAPS},
        k AS (SELECT g.flag, status, CASE WHEN price >= q1 - 0.5 * (q3 - q1) AND price <= q3 + 0.5 * (q3 - q1) THEN price END AS price
          FROM g JOIN q ON g.flag IS NOT DISTINCT FROM q.flag),
        m AS (SELECT flag, median(price) AS middle FROM k GROUP BY flag),
        c AS (SELECT flag, status, row_number() OVER (PARTITION BY flag ORDER BY count(*) DESC, status) AS place
          FROM g WHERE status IS NOT NULL GROUP BY flag, status),
        f AS (SELECT k.flag, coalesce(k.status, c.status) AS status, coalesce(price, middle) AS price FROM k
          JOIN m ON k.flag IS NOT DISTINCT FROM m.flag JOIN c ON k.flag IS NOT DISTINCT FROM c.flag AND place = 1)
        SELECT flag, status, count(*) AS n, {r6('sum(price)', 2)} AS total FROM f GROUP BY flag, status""",
    "baseline_gaps": f"""WITH {RUNS.replace("l_returnflag AS dataset", "CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS dataset")}
        {delta_sql('summed', 5).replace('ON s.dataset = b.dataset', 'ON s.dataset IS NOT DISTINCT FROM b.dataset')}""",
})
ORACLE["saved_recipe"] = order_matrix("all")
ORACLE.update({f"clean_{m}": order_matrix(m) for m in METHODS})
