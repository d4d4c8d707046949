"""SQL that several queries are held against."""

from __future__ import annotations


def counted(name: str, value: str, rows: str = "m") -> str:
    """A table of each period's distinct values with how many rows have it or less (``upto``), have it (``same``) and have any (``n``)."""
    return f"{name} AS (SELECT t, {value} AS x, sum(count(*)) OVER (PARTITION BY t ORDER BY {value}) AS upto, count(*) AS same, sum(count(*)) OVER (PARTITION BY t) AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY 1, 2)"


def placed(name: str) -> str:
    """The share of a period's other rows with a smaller value."""
    return f"CASE WHEN {name}.n > 1 THEN ({name}.upto - {name}.same)::DOUBLE / ({name}.n - 1) WHEN {name}.n = 1 THEN 0 END"


WHOLE = "whole"
DOUBLE = "double"


def plan_sql(wide: str) -> str:
    """The whole feature table over ``w`` (``wide`` defines it), written out for the columns that the landing table has."""
    z = lambda c: f"coalesce({c}, 0)"
    rows = {
        "tc_msaldototal": (f"{z('master_msaldototal')} + {z('visa_msaldototal')}", DOUBLE), "tc_mlimitecompra": (f"{z('master_mlimitecompra')} + {z('visa_mlimitecompra')}", DOUBLE), "m_activos_totales": (z("mcuentas_saldo"), DOUBLE),
        "c_trx_digitales": (z("chomebanking_transacciones"), WHOLE), "c_trx_total": (f"{z('chomebanking_transacciones')} + {z('ctarjeta_debito_transacciones')} + {z('ctarjeta_visa_transacciones')}", WHOLE),
        "tc_fechaalta_menor": ("least(master_fechaalta, visa_fechaalta)", WHOLE), "tc_fechaalta_mayor": ("greatest(master_fechaalta, visa_fechaalta)", WHOLE), "tc_status_max": (f"greatest({z('master_status')}, {z('visa_status')})", WHOLE),
    }
    over = lambda a, b: f"{a} / nullif(CAST({b} AS DOUBLE), 0)"
    second = {
        "r_tc_uso_limite": (over("tc_msaldototal", "tc_mlimitecompra"), DOUBLE), "r_payroll_saldo": (over("mpayroll", "mcuentas_saldo"), DOUBLE), "r_comisiones_rentabilidad": (over("mcomisiones", "mrentabilidad"), DOUBLE),
        "r_rentabilidad_producto": (over("mrentabilidad", "cproductos"), DOUBLE), "r_activos_pasivos": (over("mactivos_margen", "mpasivos_margen"), DOUBLE), "r_trx_producto": (over("ctrx_quarter", "cproductos"), DOUBLE),
        "r_antiguedad_edad": (over("cliente_antiguedad", "cliente_edad * 12"), DOUBLE), "f_saldo_negativo": ("(coalesce(mcuentas_saldo, 0) < 0)::INT", WHOLE), "f_caja_ahorro_negativa": ("(coalesce(mcaja_ahorro, 0) < 0)::INT", WHOLE),
        "f_sin_trx": ("(coalesce(ctrx_quarter, 0) = 0)::INT", WHOLE), "f_tc_status_anormal": ("(coalesce(master_status, 0) IN (6, 7, 9) OR coalesce(visa_status, 0) IN (6, 7, 9))::INT", WHOLE),
        "f_sin_master": ("(master_msaldototal IS NULL)::INT", WHOLE), "f_sin_visa": ("(visa_msaldototal IS NULL)::INT", WHOLE),
    }
    amounts = "mrentabilidad mrentabilidad_annual mcomisiones mactivos_margen mpasivos_margen mcuenta_corriente mcaja_ahorro mcuentas_saldo mautoservicio mtarjeta_visa_consumo mpayroll master_mlimitecompra master_msaldototal visa_mlimitecompra visa_msaldototal".split()
    numbers = "ctrx_quarter cpayroll_trx ctarjeta_debito_transacciones ctarjeta_visa_transacciones chomebanking_transacciones cproductos cliente_edad cliente_antiguedad master_status visa_status master_fechaalta visa_fechaalta active_quarter cliente_vip internet tcuentas tmobile_app".split()
    out = {"c": ("c", WHOLE), "t": ("t", WHOLE)} | {c: (c, DOUBLE) for c in amounts} | {c: (c, WHOLE) for c in numbers} | {c: (c, k) for d in (rows, second) for c, (_, k) in d.items()}
    kind = {c: k for c, (_, k) in out.items()}
    series = (
        "ctrx_quarter chomebanking_transacciones ctarjeta_debito_transacciones mcuentas_saldo mcaja_ahorro mcuenta_corriente mpasivos_margen mactivos_margen mrentabilidad mcomisiones cpayroll_trx mpayroll cproductos mautoservicio "
        "mtarjeta_visa_consumo tc_msaldototal tc_mlimitecompra r_tc_uso_limite c_trx_digitales m_activos_totales"
    ).split()
    win = {}
    for f in series:
        for n in (1, 2):
            win[f"lag_{n}_{f}"] = f"lag({f}, {n}) OVER o"
            out[f"lag_{n}_{f}"] = (f"lag_{n}_{f}", kind[f])
            out[f"delta_{n}_{f}"] = (f"{f} - lag_{n}_{f}", kind[f])
            out[f"deltapct_{n}_{f}"] = (over(f"({f} - lag_{n}_{f})", f"abs(lag_{n}_{f})"), DOUBLE)
        for s, fn in (("avg", "avg"), ("max", "max"), ("min", "min"), ("stddev", "stddev_samp")):
            win[f"{s}_3_{f}"] = f"{fn}({f}) OVER k"
            out[f"{s}_3_{f}"] = (f"{s}_3_{f}", kind[f] if s in ("max", "min") else DOUBLE)
        out[f"ratio_avg_3_{f}"] = (over(f, f"avg_3_{f}"), DOUBLE)
        age = f"CASE WHEN {f} IS NOT NULL THEN cliente_antiguedad END"
        win |= {f"b_{f}": f"regr_slope(CAST({f} AS DOUBLE), CAST(cliente_antiguedad AS DOUBLE)) OVER k", f"lo_{f}": f"min({age}) OVER k", f"hi_{f}": f"max({age}) OVER k"}
        out[f"trend_3_{f}"] = (f"CASE WHEN lo_{f} < hi_{f} THEN b_{f} END", DOUBLE)
    paid = "(coalesce(cpayroll_trx, 0) > 0)::INT"
    month = "(t // 100 * 12 + t % 100)"
    win |= {
        "present_so_far": "sum(present) OVER h", "place": "row_number() OVER o", "was_paid": f"max({paid}) OVER two", "visa_was": "max(coalesce(visa_status, 0)) OVER two", "master_was": "max(coalesce(master_status, 0)) OVER two",
        "last_trx": f"max(CASE WHEN c_trx_total > 0 THEN {month} END) OVER three", "seen": "count(*) OVER three", "top_saldo": "max(mcuentas_saldo) OVER three", "top_activos": "max(m_activos_totales) OVER three",
    }
    out |= {
        "present_so_far": ("present_so_far", WHOLE), "place": ("place", WHOLE), "f_perdio_payroll": (f"CASE WHEN was_paid = 1 AND {paid} = 0 THEN 1 ELSE 0 END", WHOLE),
        "f_visa_status_sube": ("CASE WHEN coalesce(visa_status, 0) > visa_was THEN 1 ELSE 0 END", WHOLE), "f_master_status_sube": ("CASE WHEN coalesce(master_status, 0) > master_was THEN 1 ELSE 0 END", WHOLE),
        "meses_desde_trx": (f"CASE WHEN last_trx IS NOT NULL THEN {month} - last_trx WHEN seen = 3 THEN 3 END", WHOLE), "r_saldo_vs_max": (over("mcuentas_saldo", "greatest(top_saldo, 0)"), DOUBLE), "r_activos_vs_max": (over("m_activos_totales", "greatest(top_activos, 0)"), DOUBLE),
        "racha_caida_ctrx": ("CASE WHEN ctrx_quarter < lag_1_ctrx_quarter THEN 1 + coalesce(lag_1_ctrx_quarter < lag_2_ctrx_quarter, false)::INT ELSE 0 END", WHOLE),
    }
    ranks = "mrentabilidad mrentabilidad_annual mcomisiones mactivos_margen mpasivos_margen mcuentas_saldo mcaja_ahorro mcuenta_corriente mpayroll mtarjeta_visa_consumo tc_msaldototal tc_mlimitecompra ctrx_quarter cproductos cliente_antiguedad cliente_edad chomebanking_transacciones".split()
    for f in ranks:
        out[f"pr_{f}"] = (placed(f"q_{f}"), DOUBLE)
    for f in ("mrentabilidad", "mcuentas_saldo", "ctrx_quarter", "cproductos"):
        out[f"dec_{f}"] = (f"CAST(CASE WHEN q_{f}.n IS NOT NULL THEN least(10, floor(10 * ({placed(f'q_{f}')}) + 1e-9) + 1) END AS BIGINT)", WHOLE)
    rfm = {"r": "-coalesce(meses_desde_trx, 3)", "f": "coalesce(ctrx_quarter, 0)", "m": "coalesce(mcuentas_saldo, 0)"}
    ctes = [
        "grid AS (SELECT c, t FROM (SELECT DISTINCT c FROM w), (SELECT DISTINCT t FROM w))",
        "pan AS (SELECT grid.c, grid.t, CAST(w.c IS NOT NULL AS INTEGER) AS present, w.* EXCLUDE (c, t) FROM grid LEFT JOIN w ON w.c = grid.c AND w.t = grid.t)",
        "b1 AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, (e, _) in rows.items()) + " FROM pan)", "b2 AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, (e, _) in second.items()) + " FROM b1)",
        "b AS (SELECT * FROM b2 WHERE present = 1)",
        "s AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in win.items()) + " FROM b2 WINDOW o AS (PARTITION BY c ORDER BY t), k AS (PARTITION BY c ORDER BY t ROWS 3 PRECEDING), h AS (PARTITION BY c ORDER BY t ROWS UNBOUNDED PRECEDING), "
        "two AS (PARTITION BY c ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), three AS (PARTITION BY c ORDER BY t ROWS 2 PRECEDING))",
        *(counted(f"q_{f}", f, "b") for f in ranks),
    ]
    ranked = {n for n in out if n.startswith(("pr_", "dec_"))}
    ctes.append("f AS (SELECT " + ", ".join(n if n in kind else f"{e} AS {n}" for n, (e, _) in out.items() if n not in ranked) + " FROM s WHERE present = 1)")
    ctes += [counted(f"z_{k}", e, "f") for k, e in rfm.items()]
    log = lambda x: f"round(sign({x}) * ln(1 + abs({x})), 4) + 0.0::DOUBLE"
    value = {n: f"({e})" if n in ranked else f"f.{n}" for n, (e, _) in out.items()}
    last = [f"{log(value[n]) if k == DOUBLE else f'CAST({value[n]} AS BIGINT)'} AS {n}" for n, (_, k) in out.items()]
    score = " + ".join(f"least(5, 1 + floor(5 * ({placed(f'z_{k}')}) + 1e-9))" for k in rfm)
    joins = " ".join(f"LEFT JOIN q_{f} ON q_{f}.t = f.t AND q_{f}.x = f.{f}" for f in ranks) + " " + " ".join(f"JOIN z_{k} ON z_{k}.t = f.t AND z_{k}.x = {e.replace('coalesce(', 'coalesce(f.')}" for k, e in rfm.items())
    return f"WITH {wide}, " + ", ".join(ctes) + " SELECT " + ", ".join(last) + f", CAST({score} AS BIGINT) AS rfm_score FROM f {joins}"
