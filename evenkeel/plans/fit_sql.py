"""SQL twins of the iterative fits: recursive queries with the same fixed numbers of steps."""

from __future__ import annotations

STEPS = 30


def logit_sql(p: str, margin: float = 1e-3) -> str:
    p = f"least(greatest({p}, {margin}), {1 - margin})"
    return f"ln({p} / (1 - {p}))"


def newton_ctes(name: str, start: str, keys: str, points: str, on: str, penalty: str = "0") -> list[str]:
    """Table `name` (keys, s, b) after the steps; `start` has (keys, s, b), `points` has (on, o, n)."""
    own = ", ".join(f"i.{k}" for k in keys.split(", "))
    p = "(1 / (1 + exp(-(i.b + p.o))))"
    step = f"""(any_value(i.s) - sum(p.n * {p}) - {penalty} * any_value(i.b)) / (sum(p.n * {p} * (1 - {p})) + {'1e-9' if penalty == '0' else penalty})"""
    return [f"""{name}_steps AS (SELECT 0 AS step, {keys}, s, b FROM ({start})
      UNION ALL SELECT any_value(i.step) + 1, {own}, any_value(i.s), any_value(i.b) + least(greatest({step}, -2.0), 2.0)
      FROM {name}_steps i JOIN {points} p USING ({on}) WHERE i.step < {STEPS} GROUP BY {own})""",
            f"{name} AS MATERIALIZED (SELECT {keys}, s, b FROM {name}_steps WHERE step = {STEPS})"]


def recursive(ctes: list[str], result: str) -> str:
    return "WITH RECURSIVE " + ",\n ".join(ctes) + "\n" + result


def rasch_ctes(cycles: int = 5) -> list[str]:
    """`ability` (benchmark, half, model_id, ability): levels of equal totals on either margin, solved in turn."""
    keys, fold = "benchmark, half, t, w", "benchmark, half"
    out = [f"tot_{c} AS MATERIALIZED (SELECT {fold}, {c}_id, sum(y)::BIGINT AS t, count(*) AS w FROM fx_resp GROUP BY ALL)" for c in ("model", "item")]
    for side, c in (("a", "model"), ("b", "item")):
        out.append(f"{side}0 AS MATERIALIZED (SELECT {keys}, count(*)::DOUBLE AS n, {logit_sql('t / w')} AS v FROM tot_{c} GROUP BY ALL)")
    for k in range(1, cycles + 1):
        out += newton_ctes(f"x{k}", f"SELECT {keys}, t::DOUBLE AS s, v AS b FROM a{k - 1}", keys, f"(SELECT {fold}, v AS o, n FROM b{k - 1})", fold)
        out.append(f"xn{k} AS MATERIALIZED (SELECT x.*, n FROM x{k} x JOIN a0 USING ({keys}))")
        out.append(f"c{k} AS MATERIALIZED (SELECT {fold}, sum(b * n) / sum(n) AS c FROM xn{k} GROUP BY ALL)")
        out += newton_ctes(f"z{k}", f"SELECT {keys}, t::DOUBLE AS s, v AS b FROM b{k - 1}", keys, f"(SELECT {fold}, b AS o, n FROM xn{k})", fold)
        out.append(f"a{k} AS MATERIALIZED (SELECT {keys}, n, b - c AS v FROM xn{k} JOIN c{k} USING ({fold}))")
        out.append(f"b{k} AS MATERIALIZED (SELECT {keys}, n, b + c AS v FROM z{k} JOIN b0 USING ({keys}) JOIN c{k} USING ({fold}))")
    out.append(f"ability AS MATERIALIZED (SELECT {fold}, model_id, v AS ability FROM tot_model JOIN a{cycles} USING ({keys}))")
    return out


RASCH = recursive(rasch_ctes(), "SELECT benchmark, half, model_id, round(ability, 6) AS ability FROM ability")


def family_ctes(cycles: int = 5) -> list[str]:
    """`item{cycles}` and `eff{cycles}`: intercepts and sum-zero family effects given the Rasch abilities, penalty 1."""
    item, family = "benchmark, half, item_id", "benchmark, half, item_id, family"
    out = ["""grid AS MATERIALIZED (SELECT benchmark, half, item_id, family, round(ability, 12) AS a, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s
      FROM fx_resp JOIN ability USING (benchmark, half, model_id) GROUP BY ALL)""",
           f"fam AS MATERIALIZED (SELECT {family}, sum(s) AS s FROM grid GROUP BY ALL)",
           f"eff0 AS MATERIALIZED (SELECT {family}, 0.0::DOUBLE AS effect FROM fam)"]
    out += newton_ctes("i0", f"SELECT {item}, sum(s) AS s, {logit_sql('sum(s) / sum(n)')} - sum(a * n) / sum(n) AS b FROM grid GROUP BY ALL",
                       item, f"(SELECT {item}, a AS o, n FROM grid)", item)
    out.append("item0 AS (SELECT * FROM i0)")
    for k in range(1, cycles + 1):
        out.append(f"pi{k} AS MATERIALIZED (SELECT {item}, a + effect AS o, n FROM grid JOIN eff{k - 1} USING ({family}))")
        out += newton_ctes(f"i{k}", f"SELECT * FROM item{k - 1}", item, f"pi{k}", item)
        out.append(f"pf{k} AS MATERIALIZED (SELECT {family}, a + b AS o, n FROM grid JOIN i{k} USING ({item}))")
        out += newton_ctes(f"f{k}", f"SELECT {family}, s, effect AS b FROM fam JOIN eff{k - 1} USING ({family})", family, f"pf{k}", family, "1.0")
        out.append(f"m{k} AS MATERIALIZED (SELECT {item}, avg(b) AS c FROM f{k} GROUP BY ALL)")
        out.append(f"eff{k} AS MATERIALIZED (SELECT {family}, b - c AS effect FROM f{k} JOIN m{k} USING ({item}))")
        out.append(f"item{k} AS MATERIALIZED (SELECT {item}, s, b + c AS b FROM i{k} JOIN m{k} USING ({item}))")
    return out


FAMILY_DIF = recursive([*rasch_ctes(), *family_ctes()], """SELECT benchmark, half, item_id, round(b, 6) AS intercept, family, round(effect, 6) AS effect
 FROM eff5 JOIN item5 USING (benchmark, half, item_id)""")

CELLS = f"""cells AS MATERIALIZED (SELECT t.benchmark, t.half, t.model_id, t.item_id, t.item_group AS category, (t.item_id // 8) % 3 AS fold, t.y, l.item_logit FROM fx_target t
  JOIN (SELECT benchmark, half, item_id, round({logit_sql('sum(s) / sum(n)')}, 6) AS item_logit FROM fx_rates GROUP BY ALL) l
  ON l.benchmark = t.benchmark AND l.half = t.half AND l.item_id = t.item_id)"""


def bifactor_ctes(cells: str, keys: str, grid: str, more: str, penalty: str) -> list[str]:
    """`al` (abilities by `keys`) and `th` (offsets by `keys`, `more` and category, centred, with the centre `c`) of table `cells`."""
    wide = keys + more
    out = newton_ctes("al", f"SELECT {keys}, sum(y)::DOUBLE AS s, {logit_sql('avg(y)')} - avg(item_logit) AS b FROM {cells} GROUP BY ALL",
                      keys, f"(SELECT {keys}, item_logit AS o, count(*)::DOUBLE AS n FROM {cells} GROUP BY ALL)", keys)
    out.append(f"given AS MATERIALIZED (SELECT {wide}, category, round(item_logit + b, 12) AS o, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM {grid} JOIN al USING ({keys}) GROUP BY ALL)")
    values = [penalty] if not more else penalty.split()
    for j, p in enumerate(values):
        only = f" WHERE penalty = {p}" if more else ""
        out += newton_ctes(f"raw{j}", f"SELECT {wide}, category, sum(y) AS s, 0.0::DOUBLE AS b FROM given{only} GROUP BY ALL", f"{wide}, category", "given", f"{wide}, category", p)
    union = " UNION ALL ".join(f"SELECT * FROM raw{j}" for j in range(len(values)))
    out.append(f"th AS MATERIALIZED (SELECT {wide}, category, b - avg(b) OVER (PARTITION BY {wide}) AS theta, avg(b) OVER (PARTITION BY {wide}) AS c FROM ({union}))")
    return out


BIFACTOR = recursive([CELLS, *bifactor_ctes("cells", "benchmark, half, model_id", "cells", "", "2.0")],
                     "SELECT benchmark, half, model_id, category, round(theta, 6) AS theta FROM th")


def loss_sql(z: str) -> str:
    return f"avg(ln(1 + exp(-abs({z}))) + greatest({z}, 0) - y * ({z}))"


BIFACTOR_CV = recursive(
    [CELLS, "train AS MATERIALIZED (SELECT c.* EXCLUDE (fold), h.fold AS held FROM cells c JOIN (SELECT DISTINCT fold FROM cells) h ON h.fold <> c.fold)",
     "both_ AS MATERIALIZED (SELECT *, unnest([1.0, 4.0])::DOUBLE AS penalty FROM train)",
     *bifactor_ctes("train", "benchmark, half, held, model_id", "both_", ", penalty", "1.0 4.0"),
     "test AS MATERIALIZED (SELECT * EXCLUDE (fold), fold AS held FROM cells)",
     f"""additive AS (SELECT benchmark, half, held, {loss_sql('item_logit + b')} AS additive_log_loss FROM test JOIN al USING (benchmark, half, held, model_id) GROUP BY ALL)""",
     """moved AS MATERIALIZED (SELECT DISTINCT benchmark, half, held, model_id, penalty, b + c AS ability FROM th JOIN al USING (benchmark, half, held, model_id))""",
     f"""bifactor AS (SELECT benchmark, half, held, penalty, {loss_sql('item_logit + ability + coalesce(theta, 0)')} AS bifactor_log_loss
       FROM test JOIN moved USING (benchmark, half, held, model_id) LEFT JOIN th USING (benchmark, half, held, penalty, model_id, category) GROUP BY ALL)"""],
    """SELECT benchmark, half, held, penalty, round(bifactor_log_loss, 6) AS bifactor_log_loss, round(additive_log_loss, 6) AS additive_log_loss,
  round(bifactor_log_loss - additive_log_loss, 6) AS delta_log_loss FROM bifactor JOIN additive USING (benchmark, half, held)""")
