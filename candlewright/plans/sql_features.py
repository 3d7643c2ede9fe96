"""Plain SQL for the feature columns, written from their definitions (DuckDB dialect).

`oracle(select)` puts the named common table expressions a statement needs in front.
"""

from __future__ import annotations

import re

P = "PARTITION BY symbol ORDER BY i"


def w(n: int) -> str:
    return f"OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def before(n: int) -> str:
    return f"OVER ({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def roll(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {w(n)} = {n} THEN {fn}({x}) {w(n)} END"


def prev(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({P})"


def z(x: str, n: int) -> str:
    return f"({x} - {roll('avg', x, n)}) / ({roll('stddev_samp', x, n)} + 1e-10)"


def div_sign(x: str, n: int) -> str:
    return f"sign({x} - {prev(x, n)}) - sign(close - {prev('close', n)})"


CTE: dict[str, str] = {}

CTE["bars"] = """
SELECT l_returnflag AS symbol, '1d' AS timeframe, l_shipdate AS ts,
       first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS close,
       CAST(sum(l_quantity) AS DOUBLE) AS volume
FROM lineitem GROUP BY ALL"""
CTE["b0"] = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars"
CTE["b"] = f"""
SELECT *, lag(close) OVER ({P}) AS pc, lag(open) OVER ({P}) AS po, lag(high) OVER ({P}) AS ph, lag(low) OVER ({P}) AS pl,
       (high + low + close) / 3 AS tp, high - low AS rng, abs(close - open) AS body,
       high - greatest(open, close) AS uw, least(open, close) - low AS lw
FROM b0"""
CTE["l1"] = f"""
SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
       ln(close / pc) AS lr, close - pc AS vel,
       {roll('avg', 'close', 20)} AS bb_mid, {roll('stddev_samp', 'close', 20)} AS bb_sd,
       {roll('max', 'high', 14)} AS hh14, {roll('min', 'low', 14)} AS ll14, {roll('max', 'high', 20)} AS hh20, {roll('min', 'low', 20)} AS ll20,
       {roll('max', 'high', 9)} AS hh9, {roll('min', 'low', 9)} AS ll9, {roll('max', 'high', 26)} AS hh26, {roll('min', 'low', 26)} AS ll26,
       {roll('max', 'high', 52)} AS hh52, {roll('min', 'low', 52)} AS ll52, {roll('avg', 'volume', 20)} AS vma,
       CASE WHEN tp > lag(tp) OVER ({P}) THEN tp * volume ELSE 0 END AS mf_pos, CASE WHEN tp < lag(tp) OVER ({P}) THEN tp * volume ELSE 0 END AS mf_neg,
       volume * ((close - low) / (high - low + 1e-10)) AS buy, volume * ((high - close) / (high - low + 1e-10)) AS sell,
       (lw - uw) / (rng + 1e-10) AS wpi,
       greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
       coalesce(greatest(high - ph, 0), 0) AS dm1, coalesce(greatest(pl - low, 0), 0) AS dm2
FROM b"""
CTE["l2"] = f"""
SELECT *, vel - lag(vel) OVER ({P}) AS acc, vel * vel AS energy,
       100 - 100 / (1 + ({roll('avg', 'gain', 14)}) / (({roll('avg', 'loss', 14)}) + 1e-10)) AS rsi_14,
       bb_mid + 2 * bb_sd AS bb_upper, bb_mid - 2 * bb_sd AS bb_lower, 4 * bb_sd / (bb_mid + 1e-10) AS bb_w0,
       100 * (close - ll14) / (hh14 - ll14 + 1e-10) AS stoch_k,
       100 - 100 / (1 + ({roll('sum', 'mf_pos', 14)}) / (({roll('sum', 'mf_neg', 14)}) + 1e-10)) AS mfi_14,
       volume / (vma + 1e-10) AS volume_ratio, (hh9 + ll9) / 2 AS tenkan, (hh26 + ll26) / 2 AS kijun,
       (1 - body / (rng + 1e-10)) * (rng / (({roll('avg', 'rng', 10)}) + 1e-10)) AS cct,
       CASE WHEN dm1 > dm2 THEN dm1 ELSE 0 END AS dmp,
       CASE WHEN dm2 > (CASE WHEN dm1 > dm2 THEN dm1 ELSE 0 END) THEN dm2 ELSE 0 END AS dmm
FROM l1"""
CTE["l3"] = f"""
SELECT *, ({prev('volume', 1)}) AS v1, (bb_upper - bb_lower) / (bb_mid + 1e-10) AS bb_width, {roll('avg', 'stoch_k', 3)} AS stoch_d,
       {z('vel', 20)} AS vel_z, {z('acc', 20)} AS acc_z, sign(tenkan - kijun) AS tk
FROM l2"""


def ewm_step(name: str, x: str, span: int) -> str:
    a = 2.0 / (span + 1)
    return f"e.{name} + {a!r} * (n.{x} - e.{name})"


SPANS = {"e9": 9, "e10": 10, "e20": 20, "e21": 21, "e50": 50, "e100": 100, "e200": 200, "e12": 12, "e26": 26}
ATRS = {"a7": 7, "a10": 10, "a14": 14, "a21": 21}
CTE["rec"] = f"""
SELECT symbol, i, close, tr, wpi, {', '.join(f'close AS {k}' for k in SPANS)}, {', '.join(f'tr AS {k}' for k in ATRS)},
       CAST(dmp AS DOUBLE) AS p14, CAST(dmm AS DOUBLE) AS m14, CAST(0 AS DOUBLE) AS mp FROM l2 WHERE i = 0
UNION ALL
SELECT n.symbol, n.i, n.close, n.tr, n.wpi, {', '.join(ewm_step(k, 'close', s) for k, s in SPANS.items())}, {', '.join(ewm_step(k, 'tr', s) for k, s in ATRS.items())},
       {ewm_step('p14', 'dmp', 14)}, {ewm_step('m14', 'dmm', 14)}, 0.9 * e.mp + n.wpi
FROM rec e JOIN l2 n ON n.symbol = e.symbol AND n.i = e.i + 1"""
CTE["rec1"] = """
SELECT *, e12 - e26 AS macd, 100 * p14 / (a14 + 1e-10) AS di_plus, 100 * m14 / (a14 + 1e-10) AS di_minus,
       100 * abs(100 * p14 / (a14 + 1e-10) - 100 * m14 / (a14 + 1e-10)) / (100 * p14 / (a14 + 1e-10) + 100 * m14 / (a14 + 1e-10) + 1e-10) AS dx
FROM rec"""
CTE["rec2"] = f"""
SELECT symbol, i, macd, dx, macd AS sig, dx AS adx FROM rec1 WHERE i = 0
UNION ALL
SELECT n.symbol, n.i, n.macd, n.dx, {ewm_step('sig', 'macd', 9)}, {ewm_step('adx', 'dx', 14)}
FROM rec2 e JOIN rec1 n ON n.symbol = e.symbol AND n.i = e.i + 1"""
CTE["ema"] = f"""
SELECT l3.*, r.* EXCLUDE (symbol, i, close, tr, wpi), q.sig, q.adx
FROM l3 JOIN rec1 r USING (symbol, i) JOIN rec2 q USING (symbol, i)"""

RECURSIVE = {"rec", "rec2"}


def oracle(select: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause holding exactly the expressions `select` depends on."""
    lib = {**CTE, **(extra or {})}
    order: list[str] = []

    def visit(text: str, self_name: str = "") -> None:
        for name in lib:
            if name != self_name and name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(lib[name], name)
                if name not in order:
                    order.append(name)

    visit(select)
    if not order:
        return select
    head = "WITH RECURSIVE " if set(order) & (RECURSIVE | {n for n in order if f"FROM {n} " in lib[n]}) else "WITH "
    return head + ",\n".join(f"{n} AS ({lib[n].strip()})" for n in order) + "\n" + select
