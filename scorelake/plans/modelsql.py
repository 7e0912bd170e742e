"""DuckDB twins of the split / scorecard / metric jobs, generated per config."""

from __future__ import annotations

from .sqlparts import TRAINING, with_

D = "CAST({} AS DOUBLE)"


def dbl(x) -> str:
    return D.format(repr(float(x)))


def split_ctes(test_pct: int, val_pct: int, seed: int = 42, src: str = "training", pre: str = "") -> list[str]:
    t, v = int(test_pct), int(val_pct)
    return [
        f"{pre}labeled AS (SELECT *, CASE WHEN target = 'Sí' THEN 1 ELSE 0 END AS label FROM {src})",
        f"""{pre}split AS (
  SELECT * EXCLUDE (pos, n_c),
         CASE WHEN pos < n_c * {t} // 100 THEN 'test'
              WHEN pos < n_c * {t} // 100 + (n_c - n_c * {t} // 100) * {v} // 100 THEN 'val'
              ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label
                    ORDER BY md5('{seed}~' || CAST(id AS VARCHAR)), id) - 1 AS pos,
               COUNT(*) OVER (PARTITION BY label) AS n_c FROM {pre}labeled))""",
    ]


def card_ctes(features: list[str], alpha: float = 1.0, pre: str = "", oversample: bool = False) -> list[str]:
    a = dbl(alpha)
    long = " UNION ALL ".join(
        f"SELECT label, '{f}' AS feature, CAST({f} AS VARCHAR) AS level FROM {pre}train" for f in features)
    if oversample:
        fac = (f"{pre}fac AS (SELECT greatest(1, CAST(floor(N / P) AS BIGINT)) AS fp, "
               f"greatest(1, CAST(floor(P / N) AS BIGINT)) AS fn FROM {pre}tot0)")
        tot = f"{pre}tot AS (SELECT P * fp AS P, N * fn AS N FROM {pre}tot0, {pre}fac)"
        cnt = (f"{pre}cnt AS (SELECT feature, level, pos * (SELECT fp FROM {pre}fac) AS pos, "
               f"neg * (SELECT fn FROM {pre}fac) AS neg FROM {pre}cnt0)")
    else:
        fac = None
        tot = f"{pre}tot AS (SELECT P, N FROM {pre}tot0)"
        cnt = f"{pre}cnt AS (SELECT * FROM {pre}cnt0)"
    ctes = [
        f"{pre}train AS (SELECT * FROM {pre}split WHERE split = 'train')",
        f"{pre}long AS ({long})",
        f"""{pre}tot0 AS (SELECT COUNT(*) FILTER (WHERE label = 1) AS P, COUNT(*) FILTER (WHERE label = 0) AS N
        FROM {pre}train)""",
        f"""{pre}cnt0 AS (SELECT feature, level, COUNT(*) FILTER (WHERE label = 1) AS pos,
                      COUNT(*) FILTER (WHERE label = 0) AS neg FROM {pre}long GROUP BY feature, level)""",
    ]
    if fac:
        ctes.append(fac)
    ctes += [
        tot, cnt,
        f"{pre}kk AS (SELECT feature, COUNT(*) AS k FROM {pre}cnt GROUP BY feature)",
        f"""{pre}card0 AS (
  SELECT c.feature, c.level, c.pos, c.neg, kk.k,
         ln((CAST(c.pos AS DOUBLE) + {a}) / (CAST(tot.P AS DOUBLE) + {a} * kk.k))
           - ln((CAST(c.neg AS DOUBLE) + {a}) / (CAST(tot.N AS DOUBLE) + {a} * kk.k)) AS weight,
         ln({a} / (CAST(tot.P AS DOUBLE) + {a} * kk.k)) - ln({a} / (CAST(tot.N AS DOUBLE) + {a} * kk.k)) AS unseen,
         ln(tot.P / tot.N) AS intercept
  FROM {pre}cnt c JOIN {pre}kk kk ON c.feature = kk.feature CROSS JOIN {pre}tot tot)""",
        f"""{pre}mw AS (SELECT feature, SUM((pos + neg) * weight) / (SELECT P + N FROM {pre}tot) AS mean_w
        FROM {pre}card0 GROUP BY feature)""",
        f"{pre}card AS (SELECT {pre}card0.*, {pre}mw.mean_w FROM {pre}card0 JOIN {pre}mw ON {pre}card0.feature = {pre}mw.feature)",
    ]
    return ctes


def scored_cte(features: list[str], src: str = "split", name: str = "scored",
               overrides: dict[str, str] | None = None, card: str = "card") -> str:
    """Terms, logit and p for every row of ``src``; ``overrides`` maps a
    feature to an SQL expression replacing its value (counterfactuals)."""
    overrides = overrides or {}
    joins, terms = [], []
    for i, f in enumerate(features):
        val = overrides.get(f, f"s.{f}")
        joins.append(f"LEFT JOIN {card} c{i} ON c{i}.feature = '{f}' AND c{i}.level IS NOT DISTINCT FROM CAST({val} AS VARCHAR)")
        terms.append(f"COALESCE(c{i}.weight, (SELECT min(unseen) FROM {card} WHERE feature = '{f}')) AS w_{f}")
    logit = " + ".join([f"(SELECT min(intercept) FROM {card})"] + [f"w_{f}" for f in features])
    points = " + ".join(f"CAST(round(w_{f} * 1e9) AS BIGINT)" for f in features)
    return f"""{name}0 AS (SELECT s.*, {', '.join(terms)} FROM {src} s {' '.join(joins)}),
{name} AS (SELECT *, {logit} AS logit, {points} AS points, 1.0 / (1.0 + exp(-({logit}))) AS p FROM {name}0)"""


def model_ctes(features, alpha=1.0, test_pct=20, val_pct=25, seed=42, training=(TRAINING,)) -> str:
    return with_(*training, *split_ctes(test_pct, val_pct, seed), *card_ctes(features, alpha),
                 scored_cte(features))


def run_ctes(pre: str, features, alpha, test_pct, val_pct, oversample, seed=42) -> list[str]:
    return [*split_ctes(test_pct, val_pct, seed, pre=pre), *card_ctes(features, alpha, pre, oversample),
            scored_cte(features, src=f"{pre}split", name=f"{pre}scored", card=f"{pre}card")]


def auc_select(src: str = "scored", by: str = "split", pre: str = "") -> str:
    return f"""{pre}per AS (SELECT {by}, points, COUNT(*) FILTER (WHERE label = 1) AS pos,
                 COUNT(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY {by}, points),
{pre}cum AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY {by} ORDER BY points
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM {pre}per),
{pre}aucx AS (SELECT {by}, CAST(SUM(pos * (2 * nb + neg)) AS DOUBLE)
                  / (CAST(2.0 AS DOUBLE) * SUM(pos) * SUM(neg)) AS auc_exact,
                CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg
         FROM {pre}cum GROUP BY {by}),
{pre}aucs AS (SELECT {by}, round(auc_exact, 6) AS auc, n_pos, n_neg FROM {pre}aucx)"""


def confusion_cte(src: str = "scored", where: str = "split = 'test'", cut: float = 0.5, pre: str = "") -> str:
    c = dbl(cut)
    return f"""{pre}cm AS (SELECT COUNT(*) FILTER (WHERE p < {c} AND label <> 1) AS tn,
                 COUNT(*) FILTER (WHERE p >= {c} AND label <> 1) AS fp,
                 COUNT(*) FILTER (WHERE p < {c} AND label = 1) AS fn,
                 COUNT(*) FILTER (WHERE p >= {c} AND label = 1) AS tp
          FROM {src} WHERE {where})"""


def _ratio(a, b):
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


def _f1(p, r):
    return f"COALESCE(2 * ({p}) * ({r}) / NULLIF(({p}) + ({r}), 0), 0.0)"


def report_select(pre: str = "") -> str:
    p1, r1 = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
    p0, r0 = _ratio("tn", "tn + fn"), _ratio("tn", "tn + fp")
    acc = _ratio("tp + tn", "tn + fp + fn + tp")
    f0, f1 = _f1(p0, r0), _f1(p1, r1)
    tot = "(tn + fp + fn + tp)"
    rows = [
        f"('0', {p0}, {r0}, {f0}, tn + fp)",
        f"('1', {p1}, {r1}, {f1}, tp + fn)",
        f"('accuracy', {acc}, {acc}, {acc}, {tot})",
        f"('macro avg', ({p0} + {p1}) / 2, ({r0} + {r1}) / 2, ({f0} + {f1}) / 2, {tot})",
        f"('weighted avg', {_ratio(f'({p0}) * (tn + fp) + ({p1}) * (tp + fn)', tot)}, "
        f"{_ratio(f'({r0}) * (tn + fp) + ({r1}) * (tp + fn)', tot)}, "
        f"{_ratio(f'({f0}) * (tn + fp) + ({f1}) * (tp + fn)', tot)}, {tot})",
    ]
    parts = [f"SELECT * FROM (SELECT {r[1:-1]} FROM {pre}cm) AS t(clase, pr, rc, f, sup)" for r in rows]
    return ("SELECT clase, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1, "
            "CAST(sup AS BIGINT) AS support FROM (" + " UNION ALL ".join(parts) + ")")
