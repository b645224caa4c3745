"""Code lists and labels the jobs filter and map with.

Fixed values: each list below must equal the analysis it reproduces, entry for
entry, or the filters and labels change. Keep them as written, in this order.
"""

# --- fixed values -----------------------------------------------------------

# settled purchase codes of the week-over-week report (credit or debit purchase)
PURCHASE_CODES = (
    "ISA", "ISC", "ISJ", "ISL", "ISM", "ISR", "ISZ", "VSA", "VSC", "VSJ", "VSL",
    "VSM", "VSR", "VSZ", "SDA", "SDC", "SDL", "SDM", "SDR", "SDV", "SDZ", "PLM",
    "PLA", "PRA", "SSA", "SSC", "SSZ",
)
# ATM withdrawal codes
ATM_CODES = ("VSW", "MPW", "MPM", "MPR", "PLW", "PLR", "PRW", "SDW")
# transaction codes of the weekly top-cases pull
WEEKLY_CASE_CODES = (
    "ISA", "ISC", "ISJ", "ISL", "ISM", "ISR", "ISZ", "MPM", "MPR", "MPW", "PLA",
    "PLJ", "PLM", "PLR", "PLW", "PLZ", "PRA", "PRW", "SDA", "SDC", "SDL", "SDM",
    "SDR", "SDV", "SDW", "SDZ", "VSA", "VSC", "VSJ", "VSL", "VSM", "VSR", "VSW",
    "VSZ",
)
# transaction-code prefix -> family digit used in the inspector external id
TXN_FAMILY_DIGITS = (("AD", 4), ("FE", 5), ("IS", 6), ("PM", 7), ("SD", 8), ("VS", 9))

UNAUTHORIZED_REASONS = (
    "unauthorized_transfer", "unauthorized_transaction", "unauthorized_external_transfer",
)
APPROVED_DECISIONS = ("approve", "Approved")
PENDING_RESOLUTION = "Pending Resolution"
APPROVED_RESPONSE_CODES = ("00", "10")
RULE_DENIED_RESPONSE_CODE = "59"
WITHDRAWAL_MCCS = ("6010", "6011")

# program ids
CHECKING_PROGRAMS = (512, 609, 660, 2247, 2457)
CREDIT_BUILDER_PROGRAMS = (600, 278, 1014, 2248, 2458)   # account history
CREDIT_PURCHASE_PROGRAMS = (600, 278, 1014, 2248)        # week-over-week report

# decline response code -> text (41 and 43 share one text)
DECLINE_REASONS = (
    ("51", "NSF"),
    ("04", "Inactive Card"),
    ("05", "Do Not Honor"),
    ("30", "Format Error"),
    ("41", "Lost/Stolen"),
    ("43", "Lost/Stolen"),
    ("54", "Mismatched Expry"),
    ("55", "Incorrect PIN"),
    ("57", "Card Disabled"),
    ("59", "DFE"),
    ("61", "Exceeds Limit"),
    ("75", "PIN Tries Exceeded"),
    ("N7", "Incorrect CVV"),
    ("01", "Processor Error"),
    ("85", "Address validation authorization"),
)

# rule decisions that acted on an authorisation
ACTED_RULE_OUTCOMES = (
    "hard_block", "merchant_block", "deny", "prompt_override", "sanction_block", "allow",
)

# peer-transfer posting descriptions (the received text is spelled as in the source data)
PF_SENT = "Money sent via Pay Friends"
PF_RECEIVED = "Money recieved via Pay Friends"
PA_SENT = "Money sent via Pay Anyone"
PA_RECEIVED = "Money recieved via Pay Anyone"

# postings left out of the account timeline
EXCLUDED_POSTING_DESCRIPTIONS = (
    "Savings Round-Up Transfer",
    "Savings Round-Up Transfer from Checking",
    "API Cardholder Balance Adjustments",
    "Savings Round-Up Transfer Bonus",
    "International Cash Withdrawal Fee",
    "Domestic Cash Withdrawal Fee - ATM",
    "Savings Interest",
    "Payment from the Secured Credit Funding Account to the Secured Credit Card",
)

# profile fields whose changes enter the timeline (ILIKE substrings)
PROFILE_CHANGE_FIELDS = (
    "zip_code", "status", "state_code", "phone", "last_name", "first_name", "email", "address",
)
# menu items that count as account / card views (ILIKE substrings)
APP_VIEW_ITEMS = ("account", "card")

OVERRIDE_DISABLE_RULES = "disable_fraud_rules"
CONTACT_CATEGORY_FILING = "Filing"
TIMELINE_TZ = "America/Los_Angeles"

# --- end of fixed values ----------------------------------------------------

REPORT_CODES = PURCHASE_CODES + ATM_CODES
