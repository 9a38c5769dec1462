"""Every gate must see damage: one view of a gate is damaged, and the checks that stand for it fail, of those that pass before."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from waymark import proxy
from waymark.plans import library

SF = "/root/testdata/sf0.001"
TWICE, LOST = "twice", "lost"
#: gate, view, damage (columns anew; or the rows of a condition twice, or lost), checks that must fail
CASES = [
    ("va01_check_status", "raw", {"record_id": "if(pmod(hash(record_id), 50) = 1, null, record_id)"}, {"null_key"}),
    ("va02_grain", "panel", {"unit_id": "if(unit_id = 3, null, unit_id)"}, {"null_key"}),
    ("va02_grain", "panel", (TWICE, "unit_id = 3"), {"duplicate_key", "row_count"}),
    ("va03_panel", "panel", (LOST, "unit_id = 3"), {"grid", "events_kept"}),
    ("va03_panel", "panel", {"k": "k + int(unit_id = 3)"}, {"severity_sum", "ksi_sum"}),
    ("va03_panel", "panel", {"total": "if(unit_id = 3, -1, total)"}, {"negative", "severity_sum", "events_kept"}),
    ("va04_features", "feat", {"total_mean12": "if(unit_id = 3, null, total_mean12)"}, {"null_pattern"}),
    ("va04_features", "feat", {"total_mean12": "if(unit_id = 3, double('NaN'), total_mean12)"}, {"not_a_number"}),
    ("va04_features", "feat", {"total_mean12": "if(unit_id = 3, double('Infinity'), total_mean12)"}, {"infinite"}),
    ("va04_features", "feat", {"total_lag1": "if(unit_id = 3, -1, total_lag1)"}, {"negative_lag"}),
    ("va04_features", "feat", {"history": "history + int(unit_id = 3)"}, {"order"}),
    ("va04_features", "feat", {"model_split": "if(unit_id = 3, 'unknown', model_split)"}, {"splits"}),
    ("va04_features", "feat", (TWICE, "unit_id = 3"), {"duplicate_key", "split_rows"}),
    ("va08_cross_field", "ev", {"mon": "if(unit_id = 3, mon + 1, mon)"}, {"month_matches"}),
    ("va08_cross_field", "ev", {"yr": "if(unit_id = 3, yr + 1, yr)"}, {"year_matches"}),
    ("va08_cross_field", "ev", {"month_start": "if(unit_id = 3, date_add(month_start, 1), month_start)"}, {"month_start"}),
    ("va08_cross_field", "clock", {"hour_of_day": "hour_of_day + 24", "day_of_week": "day_of_week + 1"}, {"hour", "weekday"}),
    ("va08_cross_field", "clock", {"k": "k + 1"}, {"component_sum"}),
    ("va14_mart_reconciliation", "feat", (LOST, "unit_id = 3"), {"total_sum"}),
    ("va14_mart_reconciliation", "feat", {"ksi": "ksi + int(unit_id = 3)"}, {"ksi"}),
    ("va14_mart_reconciliation", "feat", {"model_ready": "model_ready and unit_id <> 3"}, {"ready"}),
    ("va15_model_outputs", "pred", {"predicted": "if(unit_id = 3, null, predicted)"}, {"finite"}),
    ("va15_model_outputs", "pred", {"actual": "actual + int(unit_id = 3)"}, {"actuals"}),
    ("va15_model_outputs", "pred", (TWICE, "unit_id = 3"), {"duplicate_key"}),
    ("va16_forecast", "forecast", {"total": "if(unit_id = 3, -1, total)"}, {"negative", "ksi_over_total"}),
    ("va16_forecast", "forecast", (LOST, "unit_id = 3 and step = 12"), {"horizons"}),
    ("va16_forecast", "forecast", (TWICE, "unit_id = 3 and step = 12"), {"duplicate_step"}),
    ("va16_forecast", "forecast", {"factor": "factor + int(unit_id = 3)"}, {"factor"}),
    ("va16_forecast", "annual", {"total_forecast": "total_forecast + int(unit_id = 3)"}, {"annual_sum"}),
    ("va16_forecast", "annual", (LOST, "unit_id = 3"), {"units"}),
    ("va17_readiness", "shares", {"share_k": "if(unit_id = 3, share_k + 0.1, share_k)"}, {"k_a_sum"}),
    ("va17_readiness", "shares", {"share_b": "if(unit_id = 3, share_b + 0.1, share_b)"}, {"other_sum"}),
    ("va17_readiness", "shares", {"k": "k + int(unit_id = 3)"}, {"totals"}),
    ("va17_readiness", "shares", (LOST, "unit_id = 3"), {"coverage", "events"}),
    ("va18_benefits", "benefit", (TWICE, "unit_id = 3"), {"unique_key"}),
    ("va18_benefits", "benefit", {"cmf": "if(unit_id = 3, 1.5, cmf)"}, {"cmf_range"}),
    ("va18_benefits", "benefit", {"averted": "if(unit_id = 3, averted * 1.1, averted)"}, {"severity_sum"}),
    ("va18_benefits", "benefit", {"pv": "if(unit_id = 3, pv * 1.1, pv)"}, {"present_value"}),
    ("va18_benefits", "benefit", {"quantity": "quantity + 0.5"}, {"whole_quantity"}),
    ("va18_benefits", "benefit", (LOST, "unit_id = 3 and scenario = 'BASE'"), {"cmf_order"}),
    ("va19_portfolio", "sel", {"cost": "cost * 1000"}, {"budget"}),
    ("va19_portfolio", "sel", {"priority_area": "false"}, {"floor"}),
    ("va19_portfolio", "sel", {"treatment_id": "'T2'"}, {"cap"}),
    ("va19_portfolio", "sel", {"pv": "pv + 1"}, {"scenario_mixing"}),
    ("va19_portfolio", "sel", (TWICE, "1 = 1"), {"one_per_unit"}),
    ("va19_portfolio", "summ", {"cost": "cost + 1"}, {"detail_is_summary"}),
    ("va19_portfolio", "summ", {"bcr": "bcr + 1"}, {"bcr_identity"}),
    ("va20_decision_mart", "summ", (TWICE, "1 = 1"), {"unique_portfolio", "default", "row_count"}),
    ("va20_decision_mart", "summ", (LOST, f"portfolio_id = '{library.DEFAULT}'"), {"default", "row_count"}),
    ("va20_decision_mart", "sel", {"treatment_id": "'T9'"}, {"lineage"}),
    ("va21_register", "units", {"unit_name": "if(unit_id = 3, ' ', unit_name)"}, {"missing_name"}),
    ("va21_register", "units", {"grp": "if(unit_id = 3, 'ATLANTIS', grp)"}, {"group_domain"}),
    ("va21_register", "units", (TWICE, "unit_id = 3"), {"duplicate_id"}),
    ("va21_register", "register", {"status": "'lost'"}, {"status_domain"}),
    ("va21_register", "register", {"status": "'confirmed'", "confidence": "0.5"}, {"confirmed_is_sure"}),
    ("va21_register", "register", {"confidence": "2.0"}, {"confidence_range"}),
    ("va21_register", "register", {"alias": "lower(alias)"}, {"alias_not_normal"}),
    ("va21_register", "register", {"alias": "'SAME'"}, {"duplicate_alias"}),
    ("va21_register", "register", {"alias": "' '"}, {"alias_missing"}),
    ("va24_serving", "summ", {"cost": "cost + 1"}, {"filter_reconciles"}),
    ("va24_serving", "summ", (LOST, f"portfolio_id = '{library.DEFAULT}'"), {"one_default"}),
]
_before: dict[str, set[str]] = {}


def passed(rows):
    return {r.check_name for r in rows if r.passed}


def damaged(df, how):
    if isinstance(how, dict):
        return df.withColumns({c: F.expr(e) for c, e in how.items()})
    kind, condition = how
    return df.union(df.filter(condition)) if kind == TWICE else df.filter(f"not coalesce({condition}, false)")


@pytest.mark.parametrize(("gate", "view", "how", "checks"), CASES, ids=[f"{g}-{'-'.join(sorted(c))}" for g, _, _, c in CASES])
def test_gate_sees_damage(spark, monkeypatch, gate, view, how, checks):
    query = entry.queries()[gate]
    if gate not in _before:  # also makes the marts that the gate reads, so that none is made of damaged views
        _before[gate] = passed(query(spark, SF).collect())
    assert checks <= _before[gate]
    bad = damaged(proxy.Tables(spark, SF).view(view), how)

    class Damaged(proxy.Tables):
        def __init__(self, *a):
            super().__init__(*a)
            self.frames[view] = bad

    monkeypatch.setitem(proxy.MARTS, view, lambda t: bad)  # read as a table, not as a text
    monkeypatch.setattr(library, "Tables", Damaged)
    monkeypatch.setattr(proxy, "Tables", Damaged)
    rows = query(spark, SF).collect()
    assert not checks & passed(rows)
    critical = [r for r in rows if not r.passed and r.severity == "CRITICAL"]
    assert {r.status for r in rows} == {"FAIL"} and checks <= {r.check_name for r in critical}
