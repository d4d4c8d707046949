"""The pipeline's feature families by the names of its tables.

Fixed values: the names, pairs and conditions below must be the pipeline's own
for equal results.  Features whose sources a table lacks are left out (or, for
sums and counts, made of the sources it has): see ``RowSpec``.
"""

from __future__ import annotations

from cohortex.operators.features import Behaviour, RowSpec

# fixed values: columns of both cards
CARD_AMOUNTS = (
    "mfinanciacion_limite", "msaldototal", "msaldopesos", "msaldodolares", "mconsumospesos", "mconsumosdolares", "mlimitecompra", "madelantopesos", "madelantodolares", "mpagado", "mpagospesos",
    "mpagosdolares", "mconsumototal", "cconsumos", "cadelantosefectivo", "mpagominimo",
)
# fixed values: product counts
PRODUCTS = (
    "ccuenta_corriente", "ccaja_ahorro", "ctarjeta_debito", "ctarjeta_visa", "ctarjeta_master", "cprestamos_personales", "cprestamos_prendarios", "cprestamos_hipotecarios", "cplazo_fijo", "cinversion1",
    "cinversion2", "cseguro_vida", "cseguro_auto", "cseguro_vivienda", "cseguro_accidentes_personales", "ccaja_seguridad",
)
# fixed values: channels
DIGITAL = ("chomebanking_transacciones", "cmobile_app_trx")
IN_PERSON = ("ccajas_transacciones", "catm_trx", "catm_trx_other", "cextraccion_autoservicio")
CARDS_USED = ("ctarjeta_debito_transacciones", "ctarjeta_visa_transacciones", "ctarjeta_master_transacciones")
# fixed values: fields with features over time, and fields with ranks
SERIES_FIELDS = (
    "ctrx_quarter", "chomebanking_transacciones", "cmobile_app_trx", "ccajas_transacciones", "catm_trx", "ctarjeta_debito_transacciones", "ccallcenter_transacciones", "mcuentas_saldo", "mcaja_ahorro",
    "mcuenta_corriente", "mpasivos_margen", "mactivos_margen", "mrentabilidad", "mcomisiones", "mcomisiones_mantenimiento", "cpayroll_trx", "mpayroll", "cproductos", "mautoservicio", "matm",
    "mtarjeta_visa_consumo", "mtarjeta_master_consumo", "mprestamos_personales", "mtransferencias_recibidas", "mtransferencias_emitidas", "cdescubierto_preacordado", "tc_msaldototal", "tc_mconsumototal",
    "tc_mlimitecompra", "tc_mpagado", "r_tc_uso_limite", "c_trx_digitales", "c_trx_presenciales", "r_engagement_digital", "m_activos_totales", "c_productos_contratados",
)
RANK_FIELDS = (
    "mrentabilidad", "mrentabilidad_annual", "mcomisiones", "mactivos_margen", "mpasivos_margen", "mcuentas_saldo", "mcaja_ahorro", "mcuenta_corriente", "mpayroll", "mprestamos_personales",
    "mtarjeta_visa_consumo", "mtarjeta_master_consumo", "tc_msaldototal", "tc_mlimitecompra", "ctrx_quarter", "cproductos", "cliente_antiguedad", "cliente_edad", "chomebanking_transacciones",
)


def _cards(name: str) -> tuple[str, str]:
    return f"master_{name}", f"visa_{name}"


def row_spec(absent: str = "omit") -> RowSpec:
    """Families 1a to 1e; ``absent``: what becomes of sums and counts that lack a source."""
    paid = "coalesce(cpayroll_trx, 0) + coalesce(cpayroll2_trx, 0)"
    return RowSpec(
        absent=absent,
        sums={f"tc_{c}": _cards(c) for c in CARD_AMOUNTS}
        | {
            "m_activos_totales": ("mcuentas_saldo", "mplazo_fijo_pesos", "mplazo_fijo_dolares", "minversion1_pesos", "minversion1_dolares", "minversion2"),
            "m_prestamos_totales": ("mprestamos_personales", "mprestamos_prendarios", "mprestamos_hipotecarios"), "c_prestamos_totales": ("cprestamos_personales", "cprestamos_prendarios", "cprestamos_hipotecarios"),
            "c_seguros_totales": ("cseguro_vida", "cseguro_auto", "cseguro_vivienda", "cseguro_accidentes_personales"), "c_trx_digitales": DIGITAL, "c_trx_presenciales": IN_PERSON, "c_trx_total": (*DIGITAL, *IN_PERSON, *CARDS_USED),
            "c_cheques_rechazados": ("ccheques_depositados_rechazados", "ccheques_emitidos_rechazados"), "m_descuentos_total": ("mcajeros_propios_descuentos", "mtarjeta_visa_descuentos", "mtarjeta_master_descuentos"),
        },
        differences={"m_transferencias_neto": ("mtransferencias_recibidas", "mtransferencias_emitidas")},
        least={"tc_fvencimiento_menor": _cards("fvencimiento"), "tc_finiciomora_menor": _cards("finiciomora"), "tc_fultimo_cierre_menor": _cards("fultimo_cierre"), "tc_fechaalta_menor": _cards("fechaalta")},
        greatest={"tc_fvencimiento_mayor": _cards("fvencimiento"), "tc_fechaalta_mayor": _cards("fechaalta")},
        greatest_or_zero={"tc_delinquency_max": _cards("delinquency"), "tc_status_max": _cards("status")},
        positives={"c_productos_contratados": PRODUCTS},
        ratios={
            "r_tc_uso_limite": ("tc_msaldototal", "tc_mlimitecompra"), "r_tc_consumo_limite": ("tc_mconsumototal", "tc_mlimitecompra"), "r_tc_pago_saldo": ("tc_mpagado", "tc_msaldototal"),
            "r_tc_pagominimo": ("tc_mpagominimo", "tc_msaldototal"), "r_tc_dolarizacion": ("tc_msaldodolares", "tc_msaldototal"), "r_payroll_saldo": ("mpayroll", "mcuentas_saldo"),
            "r_comisiones_rentabilidad": ("mcomisiones", "mrentabilidad"), "r_rentabilidad_producto": ("mrentabilidad", "cproductos"), "r_activos_pasivos": ("mactivos_margen", "mpasivos_margen"),
            "r_prestamos_saldo": ("m_prestamos_totales", "m_activos_totales"), "r_trx_producto": ("ctrx_quarter", "cproductos"), "r_antiguedad_edad": ("cliente_antiguedad", "cliente_edad", 12),
            "r_engagement_digital": ("c_trx_digitales", ("c_trx_digitales", "c_trx_presenciales")), "r_transf_emitidas_recibidas": ("mtransferencias_emitidas", "mtransferencias_recibidas"),
        },
        flags={
            "f_sin_payroll": (f"{paid} = 0", ("cpayroll_trx", "cpayroll2_trx")), "f_saldo_negativo": ("mcuentas_saldo < 0", ("mcuentas_saldo",)), "f_caja_ahorro_negativa": ("mcaja_ahorro < 0", ("mcaja_ahorro",)),
            "f_sin_trx": ("coalesce(ctrx_quarter, 0) = 0", ("ctrx_quarter",)), "f_mora": ("master_finiciomora is not null or visa_finiciomora is not null", _cards("finiciomora")),
            "f_tc_status_anormal": ("coalesce(master_status, 0) in (6, 7, 9) or coalesce(visa_status, 0) in (6, 7, 9)", _cards("status")), "f_delinquency": ("master_delinquency > 0 or visa_delinquency > 0", _cards("delinquency")),
            "f_sin_master": ("master_msaldototal is null", ("master_msaldototal",)), "f_sin_visa": ("visa_msaldototal is null", ("visa_msaldototal",)), "f_callcenter": ("ccallcenter_transacciones > 0", ("ccallcenter_transacciones",)),
            "f_cheque_rechazado": ("ccheques_depositados_rechazados > 0 or ccheques_emitidos_rechazados > 0", ("ccheques_depositados_rechazados", "ccheques_emitidos_rechazados")),
            "f_sobregiro": ("cdescubierto_preacordado > 0 and mcuentas_saldo < 0", ("cdescubierto_preacordado", "mcuentas_saldo")),
        },
    )


def behaviour_spec() -> Behaviour:
    """Family 9, for tables that have the sources; ``fitted_behaviour`` leaves out what a table lacks."""
    return Behaviour(
        payroll=("cpayroll_trx", "cpayroll2_trx"), products="c_productos_contratados", status={"f_visa_status_sube": "visa_status", "f_master_status_sube": "master_status"},
        recency={"meses_desde_payroll": ("coalesce(cpayroll_trx, 0) + coalesce(cpayroll2_trx, 0) > 0", ("cpayroll_trx", "cpayroll2_trx")), "meses_desde_trx": ("c_trx_total > 0", ("c_trx_total",)), "meses_desde_consumo_tc": ("tc_mconsumototal > 0", ("tc_mconsumototal",))},
        balances={"r_saldo_vs_max": "mcuentas_saldo", "r_activos_vs_max": "m_activos_totales"}, activity=("racha_caida_ctrx", "ctrx_quarter"),
    )
