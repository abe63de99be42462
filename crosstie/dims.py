"""Static dimensions.

Every table here is a fixed list of at most a few hundred rows whose size does
not depend on the data, so it is safe to broadcast or to inline as a literal.
The texts (tag names, line numbers, descriptions, thresholds) are fixed values
of the filing format and of the rule book.
"""

from __future__ import annotations

from dataclasses import dataclass

MAIN = "IRS5471"
SCH_C, SCH_E, SCH_F, SCH_G = (MAIN + "Schedule" + x for x in "CEFG")
SCH_H, SCH_I, SCH_I1, SCH_J = (MAIN + "Schedule" + x for x in ("H", "I", "I1", "J"))
SCH_P, SCH_Q = MAIN + "ScheduleP", MAIN + "ScheduleQ"

#: forms filed once per separate-limitation basket
MULTI_INSTANCE_FORMS = (SCH_J, SCH_Q, SCH_P)
#: forms of the default one-row-per-entity frame
DEFAULT_FORMS = (MAIN, SCH_H, SCH_I1, SCH_E, SCH_J, SCH_Q)


@dataclass(frozen=True)
class Field:
    form: str
    name: str
    line: str
    description: str
    type: str
    sign: str | None = None
    group: str | None = None
    period: str | None = None


def _rows(text: str) -> list[list[str]]:
    return [[c.strip() for c in ln.split("|")] for ln in text.strip().splitlines()]


# --- fixed values: balance-sheet concepts (tag suffix | line | description) ---
_BALANCE_LINES = _rows("""
Cash              | 1  | Cash
TradeNotes        | 2  | Trade notes & accounts receivable
Inventories       | 3  | Inventories
InvstSubsidiary   | 4  | Investment in subsidiaries
BldgAndOtherAst   | 5  | Buildings & other depreciable assets
Land              | 6  | Land
PatentsOthAst     | 7  | Intangible assets
OtherAssets       | 8  | Other assets
TotalAssets       | 9  | Total assets
AccountsPayable   | 10 | Accounts payable
OtherCurrLiab     | 11 | Other current liabilities
OthLiabilities    | 12 | Other liabilities
CommonStock       | 13 | Capital stock
PaidInOrSurplus   | 14 | Paid-in or capital surplus
RtnEarnings       | 15 | Retained earnings
TotLiabShrEqty    | 16 | Total liabilities & shareholders equity
""")


def begin_tag(concept: str) -> str:
    return f"BegngAcctPrd{concept}Amt"


def end_tag(concept: str) -> str:
    return f"EndAcctPrd{concept}Amt"


#: (concept, line, description) of the 16 rollover pairs
BALANCE_PAIRS = [tuple(r) for r in _BALANCE_LINES]

# short names of the same 16 lines in rule texts (fixed values, same order)
BALANCE_RULE_NAMES = (
    "Cash", "Trade notes & AR", "Inventories", "Investment in subs",
    "Buildings & depreciable", "Land", "Intangibles", "Other assets",
    "Total assets", "Accounts payable", "Other current liabilities",
    "Other liabilities", "Capital stock", "Paid-in surplus",
    "Retained earnings", "Total L+E",
)

# --- fixed values: field catalogue (tag | line | description | type [| sign]) ---
_H = """
ForeignCYNetIncomePerBooksAmt  | 1        | Current year net income per books  | amount | negative_is_income
CapitalGainsOrLossesAmt        | 2a       | Capital gains or losses            | amount
DepreciationAndAmortizationAmt | 2b       | Depreciation and amortization      | amount
DepletionAmt                   | 2c       | Depletion                          | amount
InvestmentOrIncentiveAllwncAmt | 2d       | Investment or incentive allowance  | amount
ChargesToStatutoryReservesAmt  | 2e       | Charges to statutory reserves      | amount
InventoryAdjustmentsAmt        | 2f       | Inventory adjustments              | amount
TaxesNetAddnAmt                | 2g       | Income taxes (net addition)        | amount
FrgnCurrencyGainLossAddnAmt    | 2h       | Foreign currency gains/losses      | amount
OtherAdjustmentsNetAddnAmt     | 2i(add)  | Other adjustments (net addition)   | amount
OtherAdjustmentsNetSbtrctnAmt  | 2i(sub)  | Other adjustments (net subtraction)| amount
TotalNetAdditionsAmt           | 3        | Total net additions                | amount
TotalNetSubtractionsAmt        | 4        | Total net subtractions             | amount
CurrentEarningsAndProfitsAmt   | 5a       | Current E&P                        | amount | negative_is_income
DASTMGainOrLossAmt             | 5b       | DASTM gain or loss                 | amount
EarningAndPrftPlusDASTMGainAmt | 5c       | Current E&P after DASTM            | amount | negative_is_income
CurrEarnAndPrftInUSDollarsAmt  | 5d       | Current E&P in USD                 | amount | negative_is_income
ExchangeRt                     | 5d(rate) | Exchange rate (FC to USD)          | rate
EPDASTMPassiveCatIncmAmt       | 5c(PAS)  | E&P — Passive category             | amount | negative_is_income
EPDASTMGeneralCatIncmAmt       | 5c(GEN)  | E&P — General category             | amount | negative_is_income
"""
_I1 = """
GrossIncomeAmt                 | 1      | Gross income                    | amount
ExclGrossIncmEffCntdFCCorpAmt  | 2a     | Exclusion: ECI                  | amount
ExclGrossIncmSubpartFIncmAmt   | 2b     | Exclusion: Subpart F income     | amount
ExclGrossIncmHghTxdIncmAmt     | 2c     | Exclusion: High-taxed income    | amount
ExclGrossIncmDvdRcvdAmt        | 2d     | Exclusion: Dividends received   | amount
TotalExclusionsAmt             | 3      | Total exclusions                | amount
GrossIncmLessExclusionsAmt     | 4      | Gross income less exclusions    | amount
AllocableDedExpnssAmt          | 5      | Allocable deductions            | amount
TestedIncomeAmt                | 6(pos) | Tested income                   | amount
TestedLossAmt                  | 6(neg) | Tested loss                     | amount
QBAIAmt                        | 8      | QBAI                            | amount
TestedInterestExpenseAmt       | 9a     | Tested interest expense         | amount
TestedInterestIncomeAmt        | 10a    | Tested interest income          | amount
"""
_C = """
ForeignGrossReceiptsOrSalesAmt    | 1a | Gross receipts or sales              | amount
ForeignReturnsAndAllowancesAmt    | 1b | Returns and allowances               | amount
ForeignCostOfGoodsSoldAmt         | 2  | Cost of goods sold                   | amount
ForeignGrossProfitAmt             | 3  | Gross profit                         | amount
ForeignDividendIncomeAmt          | 4  | Dividends                            | amount
ForeignInterestIncomeAmt          | 5  | Interest                             | amount
ForeignNetRentRoyaltyIncomeAmt    | 8  | Rents and royalties                  | amount
ForeignNetGainLossAmt             | 9  | Gain or loss                         | amount
ForeignOtherIncomeAmt             | 11 | Other income                         | amount
ForeignTotalIncomeAmt             | 12 | Total income                         | amount
ForeignCompensationNotDeductedAmt | 13 | Compensation not deducted            | amount
ForeignInterestExpenseAmt         | 16 | Interest                             | amount
ForeignTaxesAmt                   | 17 | Taxes (exclude income tax)           | amount
ForeignDepreciationNotDeductedAmt | 18 | Depreciation not deducted elsewhere  | amount
ForeignOtherDeductionsAmt         | 19 | Other deductions                     | amount
ForeignTotalDeductionsAmt         | 20 | Total deductions                     | amount
ForeignCYNetIncomePerBookAmt      | 21 | Net income per books                 | amount
"""
_E = """
TotalTaxInFunctionalCurAmt                          | total(FC)   | Total tax in functional currency | amount
TotalTaxInUSDollarsAmt                              | total(USD)  | Total tax in USD                 | amount
Frm5471SchETestedIncomeGrp_TotalTaxInUSDollarsAmt   | tested(USD) | Tested income tax (USD)          | amount
Frm5471SchESubpartFIncomeGrp_TotalTaxInUSDollarsAmt | subF(USD)   | Subpart F income tax (USD)       | amount
"""
_G = """
DisallowedInterestExpenseInd | 15a | Disallowed interest expense (163(j))?  | indicator
CfwdPrevDsallwIntExpenseAmt  | 15b | 163(j) carryforward amount             | amount
BaseErosionPaymentBenefitInd | 6   | Base erosion payments?                 | indicator
FDIIBenefitsClaimInd         | 8   | FDII benefits claimed?                 | indicator
PayOrAccrueTopUpTaxInd       | new | Pay or accrue top-up tax (Pillar Two)? | indicator
"""
_I = """
SubpartFPHCIncomeAmt        | 1a | Subpart F — FPHCI      | amount
OtherSubpartFNotIncludedAmt | 1f | Other Subpart F income | amount
"""
_MAIN = """
ForeignCorporation_BusinessName_BusinessNameLine1Txt       | 1a       | Name of foreign corporation      | text
CountryUnderWhoseLawsIncCd                                 | 1b       | Country of incorporation         | text
FunctionalCurrencyCd                                       | 1c       | Functional currency              | text
EIN                                                        | 1d       | EIN                              | text
ForeignEntityIdentificationGrp_ForeignEntityReferenceIdNum | 1d(ref)  | Reference ID number              | text
VotingStockOwnedPct                                        | 3        | Voting stock owned %             | percentage
IncorporationDt                                            | 2b       | Date of incorporation            | date
PrincipalPlaceOfBusCountryCd                               | 2a       | Principal place of business      | text
PrincipalBusinessActivityCd                                | 2c       | Principal business activity code | text
PrincipalBusinessActivityDesc                              | 2c(desc) | Principal business activity      | text
"""
# accumulated E&P pools (tag | line prefix | description | group | movement parts)
_J_POOLS = _rows("""
Post2017EPNotPrevTaxedGrp     | 1  | Post-2017 E&P not prev taxed       | Post2017EPNotPrevTaxed   | boy,cy,eoy
Section951APTEPGrp            | 2  | Section 951A PTEP (GILTI)          | Section951APTEP          | boy,cy,reclass,eoy
Section245Ae2PTEPGrp          | 3  | Section 245A(e)(2) PTEP            | Section245Ae2PTEP        | boy,eoy
Section951a1APTEPGrp          | 4  | Section 951(a)(1)(A) PTEP (Sub F)  | Section951a1APTEP        | boy,cy,eoy
Section965aPTEPGrp            | 5a | Section 965(a) PTEP                | Section965aPTEP          | boy,eoy
Section965bPTEPGrp            | 5b | Section 965(b) PTEP                | Section965bPTEP          | boy,eoy
TotalSection964AEPGrp         | 6  | Total Section 964(a) E&P           | TotalSection964AEP       | boy,cy,eoy
Post1986UndistributedEarnGrp  | 7  | Post-1986 undistributed earnings   | Post1986UndistributedEarn| boy,cy,eoy
Pre1987EPNotPrevTaxedGrp      | 8  | Pre-1987 E&P not prev taxed        | Pre1987EPNotPrevTaxed    | boy,eoy
HoveringDeficitDedSspndTaxGrp | 9  | Hovering deficit                   | HoveringDeficit          | boy,eoy
""")
J_BOY, J_EOY = "BeginningYearBalanceAmt", "BalanceBeginningNextYearAmt"
J_CYEP, J_CYDEF = "CurrentYearEPAmt", "CurrentYearEPDeficitAmt"
_J_PARTS = {
    "boy": (J_BOY, "i", "BOY"),
    "cy": (J_CYEP, "ii", "CY E&P"),
    "reclass": ("ReclassifiedSect959c2Amt", "v", "Reclassified to 959(c)(2)"),
    "eoy": (J_EOY, "viii", "EOY"),
}


def _simple(form: str, text: str) -> list[Field]:
    return [Field(form, *r[:4], sign=r[4] if len(r) > 4 else None) for r in _rows(text)]


def _field_catalogue() -> list[Field]:
    balance = [
        Field(SCH_F, tag(c), f"{line}({col})", desc, "amount", period=period)
        for tag, col, period in ((begin_tag, "a", "beginning"), (end_tag, "b", "end"))
        for c, line, desc in _BALANCE_LINES
    ]
    pools = []
    for tag, line, desc, group, parts in _J_POOLS:
        for part in parts.split(","):
            leaf, col, label = _J_PARTS[part]
            name = desc if part != "reclass" else desc.replace(" (GILTI)", "")
            pools.append(Field(SCH_J, f"{tag}_{leaf}", f"{line}({col})", f"{name} — {label}", "amount", group=group))
    pools.append(Field(SCH_J, "SeparateCategoryCd", "header", "Separate category (basket)", "text"))
    # order of the forms decides which line a shared tag resolves to
    return (
        _simple(MAIN, _MAIN) + _simple(SCH_C, _C) + _simple(SCH_E, _E) + balance
        + _simple(SCH_G, _G) + _simple(SCH_H, _H) + _simple(SCH_I, _I)
        + _simple(SCH_I1, _I1) + pools
    )


FIELDS: list[Field] = _field_catalogue()


def fields_of(form: str) -> list[Field]:
    return [f for f in FIELDS if f.form == form]


# --- fixed values: plausible average FX bands, tried in this order ---
FX_BANDS = [
    ("GBP", 0.70, 0.90), ("EUR", 0.85, 1.10), ("AUD", 1.30, 1.80), ("CAD", 1.25, 1.50),
    ("JPY", 100.0, 160.0), ("CHF", 0.80, 1.05), ("CNY", 6.5, 7.8), ("BRL", 4.5, 6.5),
    ("INR", 75.0, 95.0), ("KRW", 1100.0, 1450.0), ("THB", 30.0, 40.0), ("SEK", 9.5, 11.5),
    ("TWD", 28.0, 35.0), ("ARS", 100.0, 2000.0), ("VND", 22000.0, 27000.0),
]

# --- fixed values: accumulated E&P pools of the rollover rule and report ---
RULE_POOLS = [
    ("Post2017EPNotPrevTaxedGrp", "Post-2017 E&P Not Previously Taxed"),
    ("TotalSection964AEPGrp", "Total Section 964(a) E&P"),
    ("Post1986UndistributedEarnGrp", "Post-1986 Undistributed Earnings"),
    ("HoveringDeficitDedSspndTaxGrp", "Hovering Deficit"),
    ("Section951APTEPGrp", "Section 951A PTEP (GILTI)"),
]
# pools of the basket rollover
BASKET_POOLS = [
    ("Post2017EPNotPrevTaxedGrp", "(a) Post-2017 E&P Not Previously Taxed"),
    ("Section951APTEPGrp", "(c) Section 951A PTEP (GILTI)"),
    ("Section951a1APTEPGrp", "(e)(i) Section 951(a)(1)(A) PTEP (Sub F)"),
    ("TotalSection964AEPGrp", "(h) Total Section 964(a) E&P"),
    ("Post1986UndistributedEarnGrp", "(i) Post-1986 Undistributed Earnings"),
    ("HoveringDeficitDedSspndTaxGrp", "(j) Hovering Deficit"),
]
# pools of the difference analysis
ANALYSIS_POOLS = [
    ("Post2017EPNotPrevTaxedGrp", "(a) Post-2017 Untaxed"),
    ("Section951APTEPGrp", "(c) 951A PTEP (GILTI)"),
    ("Section951a1APTEPGrp", "(e) 951(a)(1)(A) PTEP (SubF)"),
    ("Post1986UndistributedEarnGrp", "(i) Post-86 Undistributed"),
    ("HoveringDeficitDedSspndTaxGrp", "(j) Hovering Deficit"),
]
# the twelve pools of the report specification, number = column order
REPORT_POOLS = [
    ("Post2017EPNotPrevTaxedGrp", "(a)", "Post-2017 E&P Not Previously Taxed"),
    ("Post2017EPPrevTaxedGrp", "(b)", "Post-2017 E&P Previously Taxed"),
    ("Section951APTEPGrp", "(c)", "Section 951A PTEP (GILTI)"),
    ("Section245AdPTEPGrp", "(d)", "Section 245A(d) PTEP"),
    ("Section951a1APTEPGrp", "(e)(i)", "Section 951(a)(1)(A) PTEP (Sub F)"),
    ("Section951a1BPTEPGrp", "(e)(ii)", "Section 951(a)(1)(B) PTEP"),
    ("Section959c2PTEPGrp", "(e)(iii)", "Section 959(c)(2) PTEP (pre-2018)"),
    ("Section965aPTEPGrp", "(f)", "Section 965(a) PTEP"),
    ("Section965bPTEPGrp", "(g)", "Section 965(b) PTEP"),
    ("TotalSection964AEPGrp", "(h)", "Total Section 964(a) E&P"),
    ("Post1986UndistributedEarnGrp", "(i)", "Post-1986 Undistributed Earnings"),
    ("HoveringDeficitDedSspndTaxGrp", "(j)", "Hovering Deficit / Suspended Tax"),
]

# --- fixed values: identity and indicator fields of rules and reports ---
STATIC_RULE_FIELDS = [
    ("_entity_name", "Entity name"),
    ("IRS5471_CountryUnderWhoseLawsIncCd", "Country of incorporation"),
    ("IRS5471_FunctionalCurrencyCd", "Functional currency"),
    ("IRS5471_PrincipalPlaceOfBusCountryCd", "Principal place of business"),
]
INDICATOR_RULE_FIELDS = [
    ("IRS5471_IRS5471ScheduleG_DisallowedInterestExpenseInd", "163(j) disallowed interest"),
    ("IRS5471_IRS5471ScheduleG_BaseErosionPaymentBenefitInd", "Base erosion payments (BEAT)"),
    ("IRS5471_IRS5471ScheduleG_FDIIBenefitsClaimInd", "FDII benefits claimed"),
    ("IRS5471_IRS5471ScheduleG_PayOrAccrueTopUpTaxInd", "Top-up tax (Pillar Two)"),
]
PAGE1_FIELDS = [
    ("ForeignCorporation_BusinessName_BusinessNameLine1Txt", "Entity name", "1a"),
    ("ForeignCorporation_ForeignAddress_AddressLine1Txt", "Address line 1", "1a(addr)"),
    ("ForeignCorporation_ForeignAddress_CityNm", "City", "1a(city)"),
    ("ForeignCorporation_ForeignAddress_CountryCd", "Country code", "1a(country)"),
    ("ForeignEntityIdentificationGrp_ForeignEntityReferenceIdNum", "Reference ID", "1d"),
    ("CountryUnderWhoseLawsIncCd", "Country of incorporation", "1b"),
    ("FunctionalCurrencyCd", "Functional currency", "1c"),
    ("IncorporationDt", "Incorporation date", "2b"),
    ("PrincipalPlaceOfBusCountryCd", "Principal place of business", "2a"),
    ("EIN", "EIN", "1d"),
]
PAGE1_FORM_ORDER = [
    ("ForeignCorporation_BusinessName_BusinessNameLine1Txt", "Name of foreign corporation", "1a"),
    ("ForeignCorporation_ForeignAddress_AddressLine1Txt", "Address (number and street)", "1a"),
    ("ForeignCorporation_ForeignAddress_CityNm", "City or town", "1a"),
    ("ForeignCorporation_ForeignAddress_ProvinceOrStateNm", "State or province", "1a"),
    ("ForeignCorporation_ForeignAddress_ForeignPostalCd", "Postal code", "1a"),
    ("ForeignCorporation_ForeignAddress_CountryCd", "Country", "1a"),
    ("EIN", "Employer identification number", "1b(1)"),
    ("ForeignEntityIdentificationGrp_ForeignEntityReferenceIdNum", "Reference ID number", "1b(2)"),
    ("CountryUnderWhoseLawsIncCd", "Country under whose laws incorporated", "1c"),
    ("IncorporationDt", "Date of incorporation", "1d"),
    ("PrincipalPlaceOfBusCountryCd", "Principal place of business", "1e"),
    ("PrincipalBusinessActivityCd", "Principal business activity code", "1f"),
    ("PrincipalBusinessActivityDesc", "Principal business activity", "1g"),
    ("FunctionalCurrencyCd", "Functional currency code", "1h"),
]
BRANCH = "IRS8858"
#: fixed values: page 1 of the form of branches and disregarded entities, in its order; the tags are ours
PAGE1_BRANCH_FIELDS = [
    ("BusinessNameLine1Txt", "Name of FDE or FB", "1a"),
    ("AddressLine1Txt", "Address", "1a"),
    ("CityNm", "City", "1a"),
    ("CountryCd", "Country", "1a"),
    ("EIN", "U.S. identifying number", "1b(1)"),
    ("ReferenceIdNum", "Reference ID number", "1b(2)"),
    ("OrganizationCountryCd", "Country of organization / entity type", "1c"),
    ("OrganizationDt", "Date(s) of organization", "1d"),
    ("EffectiveDt", "Effective date as FDE", "1e"),
    ("PrincipalBusinessCountryCd", "Country of principal business activity", "1g"),
    ("BusinessActivityCd", "Business activity code", "1h"),
    ("BusinessActivityDesc", "Principal business activity", "1i"),
    ("FunctionalCurrencyCd", "Functional currency", "1j"),
    ("TaxOwnerName", "Tax owner name", "3a"),
    ("TaxOwnerCountryCd", "Tax owner country", "3d"),
    ("TaxOwnerFunctionalCurrencyCd", "Tax owner functional currency", "3e"),
]
EP_MOVEMENT_FIELDS = [
    ("ForeignCYNetIncomePerBooksAmt", "Net income per books", "1"),
    ("TotalNetAdditionsAmt", "Total additions", "3"),
    ("TotalNetSubtractionsAmt", "Total subtractions", "4"),
    ("CurrentEarningsAndProfitsAmt", "Current E&P", "5a"),
    ("CurrEarnAndPrftInUSDollarsAmt", "Current E&P (USD)", "5d"),
]
GILTI_FIELDS = [
    ("GrossIncomeAmt", "Gross income", "1"),
    ("SubpartFIncomeAmt", "Subpart F exclusion", "2b"),
    ("GrossIncomeLessTotIncmExclAmt", "Gross income less exclusions", "4"),
    ("AllocableDeductionAmt", "Allocable deductions", "5"),
    ("TestedIncomeLossGrp_USDollarAmt", "Tested income/loss (USD)", "6"),
    ("InterestExpenseAmt", "Interest expense", "9a"),
]
INDICATOR_REPORT_FIELDS = [
    ("DisallowedInterestExpenseInd", "163(j) disallowed interest?", "15a"),
    ("BaseErosionPaymentBenefitInd", "Base erosion payments?", "6"),
    ("FDIIBenefitsClaimInd", "FDII benefits claimed?", "8"),
    ("PayOrAccrueTopUpTaxInd", "Top-up tax (Pillar Two)?", "new"),
    ("ExpatriatedFrgnSubsidiaryInd", "Expatriated subsidiary?", "4"),
    ("ForeignTaxSection909Ind", "Section 909 splitter?", "7"),
    ("ReportableTransactionPrtcptInd", "Reportable transaction?", "11"),
]

# --- fixed values: income-statement lines of the line compare ---
# (FC tag | USD tag | line | description)
SCHC_LINES = _rows("""
ForeignGrossReceiptsOrSalesAmt | USGrossReceiptsOrSalesAmt    | 1a  | Gross receipts or sales
ForeignReturnsAndAllowancesAmt | USReturnsAndAllowancesAmt    | 1b  | Returns and allowances
ForeignNetGrossReceiptsAmt     | USNetGrossReceiptsAmt        | 1c  | Net gross receipts (1a - 1b)
ForeignCostOfGoodsSoldAmt      | USCostOfGoodsSoldAmt         | 2   | Cost of goods sold
ForeignGrossProfitAmt          | USGrossProfitAmt             | 3   | Gross profit (1c - 2)
ForeignInterestIncomeAmt       | USInterestIncomeAmt          | 4   | Interest income
ForeignGrossRentsAmt           | USGrossRentsAmt              | 5   | Gross rents
ForeignRentsAmt                | USRentsAmt                   | 6   | Royalties/rents
FrgnCurTransGainLossrlzdAmt    | USCurTransGainLossRlzdAmt    | 7   | FX gain/loss realized
ForeignOtherIncomeAmt          | USOtherIncomeAmt             | 8   | Other income
ForeignTotalIncomeAmt          | USTotalIncomeAmt             | 9   | Total income (3 through 8)
ForeignCompensationNotDedAmt   | USCompensationNotDedAmt      | 10  | Compensation not deducted
ForeignInterestDeductionAmt    | USInterestDeductionAmt       | 11  | Interest deductions
ForeignDepreciationNotDedAmt   | USDepreciationNotDedAmt      | 12  | Depreciation not deducted
ForeignTaxesAmt                | USTaxesAmt                   | 13  | Taxes
ForeignOtherDeductionsAmt      | USOtherDeductionsAmt         | 14  | Other deductions
ForeignTotalDeductionsAmt      | USTotalDeductionsAmt         | 15  | Total deductions (10 through 14)
FrgnTotalIncomeMinusTotDedAmt  | USTotalIncomeMinusTotDedAmt  | 16  | Net income (9 - 15)
FrgnCurrentIncomeTaxExpenseAmt | USCurrentIncomeTaxExpenseAmt | 17a | Current income tax expense
FrgnDefrdIncomeTaxExpenseAmt   | USDefrdIncomeTaxExpenseAmt   | 17b | Deferred income tax expense
ForeignCYNetIncomePerBooksAmt  | USCYNetIncomePerBooksAmt     | 18  | CY net income per books
""")
# balance-sheet lines of the line compare (concept | line | description)
SCHF_LINES = _rows("""
Cash            | 1   | Cash
TradeNotes      | 2   | Trade notes & accounts receivable
BadDebtAllwnc   | 2a  | Less: bad debt allowance
Inventories     | 3   | Inventories
OtherCurrAssets | 4   | Other current assets
LoansToShr      | 5   | Loans to shareholders
InvstSubsidiary | 6   | Investment in subsidiaries
OthInvestments  | 7   | Other investments
BldgAndOtherAst | 8a  | Buildings & other depreciable assets
NetAccumDeprec  | 8b  | Less: accumulated depreciation
Land            | 9a  | Land
NetAccumAmortz  | 9b  | Less: accumulated amortization
PatentsOthAst   | 10a | Patents/intangibles/other assets
Goodwill        | 10b | Goodwill
OtherAssets     | 11  | Other assets
TotalAssets     | 12  | TOTAL ASSETS
AccountsPayable | 13  | Accounts payable
OtherCurrLiab   | 14  | Other current liabilities
LoansFromShr    | 15  | Loans from shareholders
OthLiabilities  | 16  | Other liabilities
CommonStock     | 17  | Capital stock
PaidInOrSurplus | 18  | Paid-in or capital surplus
RtnEarnings     | 19  | Retained earnings
TotLiabShrEqty  | 20  | TOTAL LIABILITIES & EQUITY
""")


def line_columns(schedule: str) -> list[tuple[str, str, str, str, str]]:
    """(column, tag, slice, line, description) of the wide line frames C and F."""
    if schedule == "C":
        fc = [(f"FC_L{ln}", fc, "FC", ln, d) for fc, _, ln, d in SCHC_LINES]
        return fc + [(f"USD_L{ln}", usd, "USD", ln, d) for _, usd, ln, d in SCHC_LINES]
    boy = [(f"BOY_L{ln}", begin_tag(c), "BOY", ln, d) for c, ln, d in SCHF_LINES]
    return boy + [(f"EOY_L{ln}", end_tag(c), "EOY", ln, d) for c, ln, d in SCHF_LINES]


# --- fixed values: correcting-import template, 65 columns in order ---
def _import_columns() -> list[str]:
    own2 = ["Subpart F", "965(a)", "965(b)", "GILTI", "245A(e)(2)", "959(e)", "964(e)(4)"]
    passive, property_ = "Excess Passive Assets", "Investment in US Property"

    def sub(section: str, names: list[str]) -> list[str]:
        # the template spells the tax columns with two blanks, bar one item
        out = []
        for n in names:
            gap = " " if n == "Subpart F" else "  "
            out += [f"{section} SUB {n} E&P (FC)", f"{section} SUB {n} Taxes{gap}(US$)"]
        return out

    head = [
        "Entity Number", "Activity Type", "Basket Number", "Basket Name", "Tax Year",
        "Made in Tax Year", "Tax Year Begin", "Tax Year End", "Made in Year Begin",
        "Made in Year End", "Adjustment Made in Current Year", "Current Year Adjustment Type",
        "Current Year Adjustment Type Description", "Hovering Deficit Adjustment",
        "959(c)(3) Foreign Source E&P (FC)", "959(c)(3) U.S. Source E&P (FC)",
        "959(c)(3) All Sources Tax (US$)",
    ]
    c2, c1b, c1a = "959(c)(2)", "959(c)(1)(B)", "959(c)(1)(A)"
    return (
        head
        + [f"{c2} OWN {n} E&P (FC)" for n in own2] + sub(c2, own2)
        + [f"{c1b} OWN {passive} E&P (FC)"] + sub(c1b, [passive])
        + [f"{c1a} OWN {n} E&P (FC)" for n in [property_, *own2]] + sub(c1a, [property_, *own2])
    )


IMPORT_COLUMNS: list[str] = _import_columns()
# pool -> template column that carries its balance; pools that are totals have none
POOL_IMPORT_COLUMN = {
    "Post2017EPNotPrevTaxedGrp": "959(c)(3) Foreign Source E&P (FC)",
    "Section951APTEPGrp": "959(c)(2) OWN GILTI E&P (FC)",
    "Section951a1APTEPGrp": "959(c)(2) OWN Subpart F E&P (FC)",
    "HoveringDeficitDedSspndTaxGrp": "Hovering Deficit Adjustment",
}
# pool -> template columns that sum to its balance
POOL_BALANCE_COLUMNS = {
    "Post2017EPNotPrevTaxedGrp": ["959(c)(3) Foreign Source E&P (FC)", "959(c)(3) U.S. Source E&P (FC)"],
    "Section951APTEPGrp": ["959(c)(2) OWN GILTI E&P (FC)", "959(c)(2) SUB GILTI E&P (FC)"],
    "Section951a1APTEPGrp": [
        "959(c)(2) OWN Subpart F E&P (FC)", "959(c)(2) SUB Subpart F E&P (FC)",
        "959(c)(1)(A) OWN Subpart F E&P (FC)", "959(c)(1)(A) SUB Subpart F E&P (FC)",
    ],
    "HoveringDeficitDedSspndTaxGrp": ["Hovering Deficit Adjustment"],
}
BALANCE_COLUMNS: list[str] = [c for cols in POOL_BALANCE_COLUMNS.values() for c in cols]
GENERAL_BASKET, PASSIVE_BASKET = "21-General Limitation Income", "3-Passive Income"
EP_ACTIVITY = "EarningsProfitTaxes"

# --- fixed values: reconcilable workbook schedules ---
# schedule -> (form whose facts are compared, path prefix of its fields)
RECON_SCHEDULES = {
    "sch_h_fc": (SCH_H, f"{SCH_H}_"),
    "sch_i1_fc": (SCH_I1, f"{SCH_I1}_"),
    "sch_i": (SCH_I, f"{SCH_I}_"),
    "sch_c_fc": (MAIN, f"{MAIN}_{SCH_C}_"),
    "sch_f_usd": (MAIN, f"{MAIN}_{SCH_F}_"),
    "sch_e": (SCH_E, f"{SCH_E}_"),
}

#: ordered names of the seven-report package
REPORTS = ("Sch F Rollover", "Sch J Rollover", "Page 1 Rollover", "E&P Movement",
           "GILTI Comparison", "Entity Changes", "Sch G Indicators")
