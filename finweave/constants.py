"""Fixed values of the domain."""

# Jurisdictions of high risk.
HIGH_RISK_COUNTRIES = ("AF", "BY", "CF", "CD", "CG", "GN", "HT", "IR", "IQ", "KP", "LY", "ML", "MM", "NI", "PK", "PA", "RU", "SO", "SS", "SY", "VE", "YE", "ZW")
# Currencies that count as valid.
CURRENCIES = (
    "USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD", "CNY", "HKD", "SGD", "SEK", "NOK", "DKK", "MXN", "BRL", "INR", "KRW", "ZAR", "RUB",
    "TRY", "SAR", "AED", "THB", "IDR", "MYR", "PHP", "PLN", "CZK", "HUF", "ILS", "CLP", "COP", "PEN", "VND", "NGN", "EGP", "PKR", "BDT", "QAR",
    "KWD", "OMR", "BHD", "JOD", "LBP", "MAD", "TND", "GHS", "KES", "TZS",
)
MAX_AMOUNT = 10_000_000
ACCOUNT_PATTERN = r"^[A-Za-z0-9\-]{6,34}$"
STRUCTURING_LOW, STRUCTURING_HIGH = 9_000, 10_000
HIGH_VALUE = 10_000
# Weights of the scoring factors.
FACTOR_WEIGHTS = {
    "TRANSACTION_AMOUNT": 0.20, "VELOCITY": 0.15, "GEOGRAPHY": 0.15, "CUSTOMER_TYPE": 0.10,
    "PEP_STATUS": 0.15, "ADVERSE_MEDIA": 0.10, "NETWORK_CENTRALITY": 0.10, "LAYERING_DETECTED": 0.05,
}
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
# Weights of the fields of an entity.
ENTITY_WEIGHTS = {"name": 0.35, "address": 0.20, "dob": 0.15, "national_id": 0.20, "account_numbers": 0.10}
# Legal forms left out of names and abbreviations written out in addresses.
LEGAL_FORMS = ("ltd", "limited", "inc", "incorporated", "llc", "corp", "corporation", "co")
ADDRESS_WORDS = {"st": "street", "ave": "avenue", "blvd": "boulevard", "rd": "road", "dr": "drive", "ln": "lane", "apt": "apartment", "fl": "floor"}
# Other names of the fields of a raw record; of several, the later one counts.
ALIASES = {
    "txn_id": "transaction_id", "tx_id": "transaction_id", "src_account": "source_account", "src_acct": "source_account", "dst_account": "destination_account",
    "dest_account": "destination_account", "dst_acct": "destination_account", "amt": "amount", "ccy": "currency", "ts": "timestamp", "transaction_time": "timestamp",
    "txn_type": "transaction_type", "type": "transaction_type",
}
ALERT_TYPES = ("STRUCTURING", "LAYERING", "RAPID_MOVEMENT", "HIGH_VALUE", "GEOGRAPHY", "PEP", "ADVERSE_MEDIA", "NETWORK_ANOMALY")
ALERT_STATUSES = ("OPEN", "UNDER_REVIEW", "CLOSED", "ESCALATED", "FALSE_POSITIVE")
CASE_STATUSES = ("NEW", "IN_PROGRESS", "PENDING_INFO", "CLOSED_SAR", "CLOSED_NO_ACTION", "ESCALATED_TO_COMPLIANCE")
PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
