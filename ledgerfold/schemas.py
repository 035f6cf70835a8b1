"""Declared schemas of the raw and clean tables; absence is an empty string for text and null for dates and numbers."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

TENDERS = _of(tender_id=_S, reference=_S, status=_S, note=_S, nature=_S, title=_S, ministry=_S, organization=_S, procuring_entity=_S, procurement_type=_S, method=_S, published_at=_S, closing_at=_S, fetched_at=_S)
CONTRACTS = _of(tender_id=_S, reference=_S, title=_S, advertised_at=_S, ministry=_S, procuring_entity=_S, method=_S, district=_S, signed_on=_S, awardee=_S, value_crore=_D, fetched_at=_S)
DETAILS = _of(tender_id=_S, categories=_S, security_bdt=_D, document_price_bdt=_D, brief=_S, budget_type=_S, source_of_funds=_S, procuring_entity_district=_S, method=_S, app_id=_S, package_no=_S, fetched_at=_S)
PLAN_ESTIMATES = _of(tender_id=_S, app_id=_S, package_no=_S, matched=_B, plan_rows=_L, estimate_bdt=_D, plan_method=_S, plan_package_no=_S, pkg_id=_S, fetched_at=_S)
BIDDERS = _of(bidder_id=_S, canonical_name=_S, variants=_S, n_awards=_L, total_value_crore=_D, first_award=_S, last_award=_S, recent_awards=_S, flags=_S)
ENTITIES = _of(pe_id=_S, name=_S, ministry=_S, n_contracts=_L, n_tenders=_L, recent_awards=_S, top_bidders=_S, flags=_S)
PREDICTIONS = _of(tender_id=_S, q10_lakh=_D, q50_lakh=_D, q90_lakh=_D, deferred=_B, basis=_S, model_version=_S)

ENDPOINTS = {"tenders": TENDERS, "contracts": CONTRACTS, "details": DETAILS, "plan_estimates": PLAN_ESTIMATES}
CLEAN = {"bidders": BIDDERS, "procuring_entities": ENTITIES, "predictions": PREDICTIONS}
