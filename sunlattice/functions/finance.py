"""Payback of a plant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Money per kW, hours per year, notes.
CAPEX_PER_KW, OPEX_PER_KW, HOURS = 75000.0, 1000.0, 8760.0
NOTE_NEVER = "Проект не окупается при текущих параметрах."
NOTE_DONE = "Окупаемость рассчитана."
DEFAULT_TARIFF = 8.5


def payback(cf: Column, power_kw: Column, tariff: Column) -> dict[str, Column]:
    """capex, opex_year, revenue_year, payback_years (NULL if revenue doesn't exceed cost) and its note."""
    capex = F.lit(CAPEX_PER_KW) * power_kw
    opex = F.lit(OPEX_PER_KW) * power_kw
    revenue = cf * HOURS * power_kw * tariff
    pays = F.coalesce((revenue - opex > 0) & ~F.isnan(revenue), F.lit(False))
    return {
        "capex_rub": capex,
        "opex_year_rub": opex,
        "revenue_year_rub": revenue,
        "payback_years": F.when(pays, capex / F.when(pays, revenue - opex)),
        "payback_note": F.when(pays, NOTE_DONE).otherwise(NOTE_NEVER),
    }


def rounded_response(cf: Column, power_kw: Column, tariff: Column) -> dict[str, Column]:
    """The response columns: cf to 6 digits, percent and money to 2, years to 3."""
    p = payback(cf, power_kw, tariff)
    digits = {"capex_rub": 2, "opex_year_rub": 2, "revenue_year_rub": 2, "payback_years": 3}
    out = {"cf": F.round(cf, 6), "cf_percent": F.round(cf * 100, 2)}
    out |= {k: F.round(c, digits[k]) if k in digits else c for k, c in p.items()}
    return out


def valid_request(lat: Column, lon: Column, power_kw: Column, tariff: Column) -> Column:
    """The range rules of a request; a missing tariff is valid (the default applies)."""
    in_range = lat.between(-90, 90) & lon.between(-180, 180) & power_kw.between(0.1, 586) & (F.coalesce(tariff, F.lit(DEFAULT_TARIFF)) > 0)
    return F.coalesce(in_range, F.lit(False))
