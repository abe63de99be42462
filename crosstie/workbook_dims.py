"""Static layout of the compliance workbook (fixed values of its template)."""

from __future__ import annotations

from dataclasses import dataclass

from crosstie.dims import _rows

#: schedule -> sheet names that may carry it, in order of preference
SHEET_CANDIDATES = {
    "sch_h_fc": ["5471 Sch H - FC", "5471 Sch H"],
    "sch_i1_fc": ["5471 Sch I-1 - FC", "5471 Sch I-1"],
    "sch_i1_usd": ["5471 Sch I-1 - USD"],
    "sch_i": ["5471 Sch I"],
    "sch_c_fc": ["5471 Sch C - FC", "C - FC"],
    "sch_c_usd": ["5471 Sch C - USD", "C - USD"],
    "sch_f_usd": ["5471 Sch F - USD", "5471 Sch F"],
    "sch_e": ["5471 Sch E"],
    "sch_g": ["5471 Sch G"],
    "gilti_calc": ["2025 GILTI", "2024 GILTI", "GILTI"],
    "subf_summary": ["Subpart F - Summary"],
    "de_minimis": ["De Minimis - Analysis", "De Minimis"],
    "entity_listing": ["Entity Listing"],
}


@dataclass(frozen=True)
class MatrixLayout:
    """A sheet with entities across columns; row and column numbers start at 1."""

    header_row: int
    first_row: int
    first_col: int
    lines: tuple[tuple[int, str, str], ...]  # (row offset, line, field)


def _layout(header_row: int, first_row: int, first_col: int, text: str) -> MatrixLayout:
    return MatrixLayout(header_row, first_row, first_col, tuple((int(o), ln, f) for o, ln, f in _rows(text)))


_C_LINES = """
0  | 1a  | ForeignGrossReceiptsOrSalesAmt
1  | 1b  | ForeignReturnsAndAllowancesAmt
2  | 1c  | ForeignNetReceiptsAmt
3  | 2   | ForeignCostOfGoodsSoldAmt
4  | 3   | ForeignGrossProfitAmt
5  | 4   | ForeignDividendIncomeAmt
6  | 5   | ForeignInterestIncomeAmt
7  | 6a  | ForeignGrossRentsAmt
8  | 6b  | ForeignGrossRoyaltiesAmt
9  | 7   | ForeignNetGainLossAmt
10 | 8a  | ForeignCurrencyUnrealizedAmt
11 | 8b  | ForeignCurrencyRealizedAmt
12 | 9   | ForeignOtherIncomeAmt
13 | 10  | ForeignTotalIncomeAmt
14 | 11  | ForeignCompensationNotDeductedAmt
15 | 12a | ForeignRentsDeductionAmt
16 | 12b | ForeignRoyaltiesDeductionAmt
17 | 13  | ForeignInterestExpenseAmt
18 | 14  | ForeignDepreciationNotDeductedAmt
19 | 15  | ForeignDepletionAmt
20 | 16  | ForeignTaxesAmt
21 | 17  | ForeignOtherDeductionsAmt
22 | 18  | ForeignTotalDeductionsAmt
23 | 19  | ForeignNetIncomeBeforeTaxAmt
24 | 20  | ForeignUnusualItemsAmt
25 | 21a | ForeignIncomeTaxCurrentAmt
26 | 21b | ForeignIncomeTaxDeferredAmt
27 | 22  | ForeignCYNetIncomePerBookAmt
28 | 23a | ForeignCurrencyTranslationAmt
29 | 23b | ForeignOtherComprehensiveAmt
30 | 23c | ForeignIncomeTaxOCIAmt
31 | 24  | ForeignTotalComprehensiveAmt
"""

MATRIX_LAYOUTS: dict[str, MatrixLayout] = {
    "sch_h_fc": _layout(4, 11, 5, """
        0  | 1      | ForeignCYNetIncomePerBooksAmt
        2  | 2a     | CapitalGainsOrLossesAmt
        3  | 2b     | DepreciationAndAmortizationAmt
        4  | 2c     | DepletionAmt
        5  | 2d     | InvestmentOrIncentiveAllwncAmt
        6  | 2e     | ChargesToStatutoryReservesAmt
        7  | 2f     | InventoryAdjustmentsAmt
        8  | 2g     | TaxesNetAddnAmt
        9  | 2h     | FrgnCurrencyGainLossAddnAmt
        10 | 2i_sub | OtherAdjustmentsNetSbtrctnAmt
        11 | 2i_add | OtherAdjustmentsNetAddnAmt
        13 | 3      | TotalNetAdditionsAmt
        14 | 4      | TotalNetSubtractionsAmt
        15 | 5a     | CurrentEarningsAndProfitsAmt
        16 | 5b     | DASTMGainOrLossAmt
        17 | 5c     | EarningAndPrftPlusDASTMGainAmt
        18 | 5d     | CurrEarnAndPrftInUSDollarsAmt
    """),
    "sch_i1_fc": _layout(4, 9, 3, """
        0  | 1  | GrossIncomeAmt
        1  | 2a | ExclGrossIncmEffCntdFCCorpAmt
        2  | 2b | ExclGrossIncmSubpartFIncmAmt
        3  | 2c | ExclGrossIncmHghTxdIncmAmt
        4  | 2d | ExclGrossIncmDvdRcvdAmt
        5  | 2e | ExclGrossIncmFrgnOilGasAmt
        6  | 3  | TotalExclusionsAmt
        7  | 4  | GrossIncmLessExclusionsAmt
        8  | 5  | AllocableDedExpnssAmt
        9  | 6  | TestedIncomeLossAmt
        10 | 7  | TestedForeignIncomeTaxesAmt
        11 | 8  | QBAIAmt
    """),
    "sch_i": _layout(4, 9, 3, """
        0  | 1a | Sect964e4SubpartFDvdAmt
        1  | 1b | Sect245Ae2SubpartFIncmAmt
        2  | 1c | TieredExtraordinaryDisposAmt
        3  | 1d | TieredExtraordinaryReductAmt
        4  | 1e | SubpartFPHCIncomeAmt
        5  | 1f | FBCSalesIncomeAmt
        6  | 1g | FBCServicesIncomeAmt
        7  | 1h | OtherSubpartFIncomeAmt
        8  | 2  | EarningsInvestedUSPropAmt
        10 | 4  | FactoringIncomeAmt
        11 | 5a | Sect245AEligibleDividendsAmt
        12 | 5b | ExtraordinaryDispositionAmt
    """),
    "sch_c_fc": _layout(5, 11, 3, _C_LINES),
    "sch_c_usd": _layout(5, 11, 3, _C_LINES),
    "sch_f_usd": _layout(5, 11, 3, """
        0  | 1   | EndAcctPrdCashAmt
        1  | 2a  | EndAcctPrdTradeNotesAmt
        2  | 2b  | EndAcctPrdBadDebtAllowanceAmt
        3  | 3   | EndAcctPrdDerivativesAmt
        4  | 4   | EndAcctPrdInventoriesAmt
        5  | 5   | EndAcctPrdOtherCurrentAmt
        6  | 6   | EndAcctPrdLoansToShareholdersAmt
        7  | 7   | EndAcctPrdInvstSubsidiaryAmt
        8  | 8   | EndAcctPrdOtherInvestmentsAmt
        9  | 9a  | EndAcctPrdBldgAndOtherAstAmt
        10 | 9b  | EndAcctPrdAccumDepreciationAmt
        11 | 10a | EndAcctPrdDepletableAssetsAmt
        12 | 10b | EndAcctPrdAccumDepletionAmt
        13 | 11  | EndAcctPrdLandAmt
        14 | 12  | EndAcctPrdIntangibleAssetsAmt
        15 | 12a | EndAcctPrdGoodwillAmt
        16 | 12b | EndAcctPrdOrgCostsAmt
        17 | 12c | EndAcctPrdPatentsOthAstAmt
        18 | 12d | EndAcctPrdAccumAmortizationAmt
        19 | 13  | EndAcctPrdOtherAssetsAmt
        20 | 14  | EndAcctPrdTotalAssetsAmt
        29 | 15  | EndAcctPrdAccountsPayableAmt
        30 | 16  | EndAcctPrdOtherCurrLiabAmt
        31 | 17  | EndAcctPrdLiabDerivativesAmt
        32 | 18  | EndAcctPrdLoansFromShareholdersAmt
        33 | 19  | EndAcctPrdOthLiabilitiesAmt
        34 | 20  | EndAcctPrdCapitalStockAmt
        35 | 20a | EndAcctPrdPreferredStockAmt
        36 | 20b | EndAcctPrdCommonStockAmt
        37 | 21  | EndAcctPrdPaidInOrSurplusAmt
        38 | 22  | EndAcctPrdRtnEarningsAmt
        39 | 23  | EndAcctPrdTreasuryStockAmt
        40 | 24  | EndAcctPrdTotLiabShrEqtyAmt
    """),
    "sch_e": _layout(5, 9, 3, """
        0 | d | SchECountryCodeTxt
        1 | e | SchEForeignTaxYearTxt
        2 | f | SchEUSTaxYearTxt
        3 | g | SchEIncomeSubjectToTaxAmt
        4 | h | SchETaxesPaidUSSourceInd
        5 | i | SchELocalCurrencyTxt
        6 | j | TotalTaxInFunctionalCurAmt
        7 | k | SchETranslationRateRt
        8 | l | TotalTaxInUSDollarsAmt
        9 | m | SchETaxInFunctionalCurAmt
    """),
    "sch_g": _layout(6, 10, 7, """
        0  | 1  | SchGLine1Ind
        1  | 2  | SchGLine2Ind
        2  | 3  | SchGLine3Ind
        3  | 4A | BaseErosionPaymentBenefitInd
        4  | 4B | SchGLine4BAmt
        5  | 4C | SchGLine4CAmt
        6  | 5A | SchGLine5AInd
        7  | 5B | SchGLine5BAmt
        8  | 6A | SchGLine6AInd
        9  | 6B | SchGLine6BAmt
        10 | 6C | SchGLine6CAmt
        11 | 6D | SchGLine6DAmt
        12 | 7  | SchGLine7Ind
        13 | 8  | SchGLine8Ind
        14 | 9A | SchGLine9AInd
        15 | 9B | SchGLine9BAmt
        16 | 10 | SchGLine10Ind
        17 | 11 | SchGLine11Ind
        18 | 12 | SchGLine12Ind
        19 | 13 | SchGLine13Ind
    """),
}

#: tested-income sheet: header text -> field
GILTI_HEADER_ROW = 7
GILTI_COLUMNS = {
    "FC": "functional_currency",
    "Entity Name": "entity_name",
    "Type of Entity": "entity_type",
    "Book Income": "book_income",
    "E&P Adjustments": "ep_adjustments",
    "163(j) Disallowance / (CF)": "s163j_disallowance",
    "Net Subpart F Pre FI": "net_subf_pre_fi",
    "Full Inclusion - Other Sub F": "full_inclusion_other_subf",
    "Tested Income": "tested_income_fc",
    "FX": "fx_rate",
    "Tested Loss (USD)": "tested_loss_usd",
    "QBAI": "qbai",
    "Interest Expense": "interest_expense",
    "Interest Income": "interest_income",
    "Specified Interest Expense": "specified_interest_expense",
    "Foreign Taxes": "foreign_taxes",
}

#: positional row sheets: (first data row, code column, ((column, field, is_text), ...))
ROW_LAYOUTS = {
    "subf_summary": (7, 2, (
        (3, "entity_name", True), (4, "pre_tax_subpart_f", False), (5, "tax_on_subf", False),
        (6, "etr_on_subf", False), (7, "eligible_high_tax", True), (8, "net_subpart_f", False),
    )),
    "de_minimis": (8, 1, (
        (2, "entity_name", True), (3, "interest_income", False), (4, "dividend_income", False),
        (5, "fx_gain_loss", False), (6, "passive_fphci", False), (7, "fphci_ic_interest", False),
        (8, "us_source_fphci", False),
    )),
}

#: registry sheet: first data row and column -> field
ENTITY_LISTING_ROW = 3
ENTITY_LISTING_COLUMNS = {
    3: "entity_code", 4: "name", 5: "form_type", 2: "le_id", 8: "ein_or_ref",
    9: "functional_currency", 10: "country_code", 6: "final_return", 7: "dormant",
    11: "tax_period_begin", 12: "tax_period_end",
}

#: alternate profile: sheet, header rows and data rows
FOREIGN_SUMMARY_SHEET = "Foreign Summary"
FOREIGN_SUMMARY_CODES, FOREIGN_SUMMARY_NAMES, FOREIGN_SUMMARY_CURRENCY = 5, 6, 8
FOREIGN_SUMMARY_ROWS = {
    13: "pbt_usd", 15: "net_income_usd", 73: "total_ep", 76: "pretax_ep", 80: "subpart_f",
    82: "dividends", 87: "tested_income_loss", 88: "tested_foreign_taxes",
    89: "pretax_tested_income", 100: "tested_income_after_hte", 103: "qbai",
    107: "interest_income", 112: "interest_expense", 118: "income_taxes",
}
#: schedules derived from single rows of that sheet: schedule -> (row, field)
FOREIGN_SUMMARY_DERIVED = {
    "sch_h_fc": (73, "CurrEarnAndPrftInUSDollarsAmt"),
    "sch_i1_fc": (100, "TestedIncomeLossGrp_USDollarAmt"),
}

#: E&P adjustment summary: first data row, columns of code, currency, E&P in FC and USD
EP_SUMMARY_SHEET = "FY25 E&P Adjs Summary"
EP_SUMMARY_ROW, EP_SUMMARY_CODE, EP_SUMMARY_CURRENCY, EP_SUMMARY_FC, EP_SUMMARY_USD = 6, 1, 4, 13, 14
