"""What values look like: per label, rules in order of trial; the first that matches and validates counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

# Two-letter state codes as they stand in the formats below.
_STATES_VEHICLE = "AN|AP|AR|AS|BR|CG|CH|DD|DL|DN|GA|GJ|HP|HR|JH|JK|KA|KL|LA|LD|MH|ML|MN|MP|MZ|NL|OD|PB|PY|RJ|SK|TN|TR|TS|UK|UP|WB"
_STATES_LICENCE = "ap|ar|as|br|cg|ch|dl|ga|gj|hp|hr|jh|jk|ka|kl|la|ld|mh|ml|mn|mp|mz|nl|od|pb|py|rj|sk|tg|tn|tr|ts|uk|up|wb|an|dd|dn"
_STATES_COMPANY = "AN|AP|AR|AS|BR|CH|CG|DD|DL|DN|GA|GJ|HP|HR|JH|JK|KA|KL|LA|LD|MH|ML|MN|MP|MZ|NL|OD|PB|PY|RJ|SK|TN|TR|TS|UK|UP|WB"
_STATES_RATION = "AP|AR|AS|BR|CG|CH|DL|GA|GJ|HP|HR|JH|JK|KA|KL|LA|MH|ML|MN|MP|MZ|NL|OD|PB|PY|RJ|SK|TN|TR|TS|UK|UP|WB|AN|DD|DN"

# Payment handles of the virtual payment address.
_HANDLES = (
    "ybl|ibl|axl|okaxis|okhdfcbank|okicici|oksbi|paytm|ptsbi|pthdfc|ptaxis|ptyes|apl|rapl|yapl|waaxis|waicici|wahdfcbank|wasbi|yesg|yescred|yespop|superyes|"
    "ikwik|mvhdfc|fkaxis|indie|federal|fifederal|icici|axisb|hsbc|idbi|indianbank|allbank|kotak|kotak811|barodampay|pnb|unionbank|canara|bob|sbi|hdfcbank|"
    "icicibank|axisbank|idfcfirst|idfc|rbl|bandhan|yesbank|indus|indusind|au|aubank|equitas|ujjivan|airtel|freecharge|famapp|slice|cred|groww|jupiter|"
    "mobikwik|amazonpay|flipkart|phonepe|gpay|bhim|upi"
)


@dataclass(frozen=True)
class Rule:
    pattern: str
    weight: float
    region: str | None = None
    gated: bool = False


def _india(pattern: str, weight: float, gated: bool = False) -> Rule:
    return Rule(pattern, weight, "india", gated)


# Formats in RE2 syntax and weights, in order of trial. Texts are lower-cased before, so the last token format never matches.
VALUE_RULES: dict[str, list[Rule]] = {
    "Email": [
        Rule(r"\b[\w][\w+.-]+(@|%40)[a-z\d-]+(\.[a-z\d-]+)*\.[a-z]+\b", 1.0),
        Rule(r"(?i)([A-Za-z0-9!#$%&'*+\/=?^_{|.}~-]+@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)", 1.0),
    ],
    "PANNumber": [
        _india(r"\b([A-Za-z]{3}[AaBbCcFfGgHhJjLlPpTt]{1}[A-Za-z]{1}[0-9]{4}[A-Za-z]{1})\b", 0.85),
        _india(r"\b([A-Za-z]{5}[0-9]{4}[A-Za-z]{1})\b", 0.85),
    ],
    "AdharcardNumber": [
        _india(r"\b\d{12}\b", 0.8),
        _india(r"\b\d{4}[- ]\d{4}[- ]\d{4}\b", 0.8),
        _india(r"\(\d{4}\)\s\d{4}\s\d{4}", 0.8),
        _india(r"\b\d{4}[.\s_-]\d{4}[.\s_-]\d{4}\b", 0.8),
    ],
    "BankAccountNumber": [_india(r"^(?:\d[\s\-]?){9,18}$", 0.6, True)],
    "DematAccountNumber": [_india(r"\bin\d{14}\b", 0.95), _india(r"\b(12|13|16|11|10)\d{14}\b", 0.95)],
    "ChequeNumber": [_india(r"^\d{6}$", 0.6)],
    "CIFNumber": [_india(r"(?i)\bCIF\d{6,12}\b", 0.9), _india(r"(?i)\b\d{8,11}\b", 0.6)],
    "LoanAccountNumber": [_india(r"\b[A-Za-z0-9][A-Za-z0-9\-_/]{8,25}[A-Za-z0-9]\b", 0.6, True)],
    "InsurancePolicyNumber": [_india(r"\b[A-Za-z0-9][A-Za-z0-9\-_]{6,25}[A-Za-z0-9]\b", 0.6, True)],
    "FASTagID": [_india(r"(?i)\b[A-Z0-9]{10,24}\b", 0.6, True)],
    "UPIID": [_india(rf"(?i)\b[\w.\-]{{2,}}@({_HANDLES})\b", 1.2)],
    "CVV": [Rule(r"^[0-9]{3,4}$", 0.9)],
    "TAN": [_india(r"(?i)\b[A-Z]{4}[0-9]{5}[A-Z]\b", 0.9)],
    "CIN": [_india(rf"(?i)\b[LU][0-9]{{5}}(?:{_STATES_COMPANY})(?:18|19|20|21)[0-9]{{2}}[A-Z]{{3}}[0-9]{{6}}\b", 0.95)],
    "DrivingLicenceNumber": [
        _india(rf"(?i)^((?:{_STATES_LICENCE})[\s_-]?[0-9]{{2}}[\s_-]?(?:19[89][0-9]|20[012][0-9])[\s_-]?[0-9]{{7}})$", 1.0),
        _india(rf"(?i)\b((?:{_STATES_LICENCE})[\s_-]?[0-9]{{2}}[\s_-]?[0-9]{{11}})\b", 0.9),
    ],
    "Gender": [
        Rule(r"(?i)^(male|female|girl|boy|other|prefer[\s-_]?not[\s-_]?to[\s-_]?say|prefer[\s-_]?not[\s-_]?to[\s-_]?disclose|not[\s-_]?specified|transgender|non[\s-_]?binary)$", 1.0),
        Rule(r"(?i)^(m|f|n)$", 0.3),
    ],
    "Phone": [
        _india(r"\b[6-9][0-9]{9}\b", 1.0),
        _india(r"\b0[6-9][0-9]{9}\b", 1.0),
        _india(r"\b91[6-9][0-9]{9}\b", 1.0),
        _india(r"\+91[\s-]?[6-9][0-9]{4}[\s-]?[0-9]{5}", 1.0),
    ],
    "CreditCard": [
        Rule(r"\b([234568]\d{3}[\s\-]*\d{4}[\s\-]*\d{4}[\s\-]*\d{4})\b", 1.0),
        Rule(r"\b[234568]\d{15}\b", 1.0),
        Rule(r"\b(3[47]\d{2}[\s\-]\d{4,6}[\s\-]\d{3,5})\b", 1.0),
        Rule(r"\b3[47]\d{13}\b", 1.0),
    ],
    "VoterID": [_india(r"(?i)\b[A-Z]{3}\d{7}\b", 0.8)],
    "IFSC": [_india(r"(?i)^[A-Z]{4}0[A-Z0-9]{6}$", 1.0)],
    "MICRCode": [_india(r"^\d{9}$", 0.7)],
    "PassportNumber": [_india(r"(?i)\b[A-Z][0-9]{7}\b", 1.0), _india(r"(?i)\b[A-Z]{2}[0-9]{6}\b", 1.0)],
    "ABHANumber": [_india(r"\b\d{2}-\d{4}-\d{4}-\d{4}\b", 1.0), _india(r"\b\d{2}\s\d{4}\s\d{4}\s\d{4}\b", 1.0), _india(r"\b\d{14}\b", 0.6)],
    "UAN": [_india(r"\b[1-9][0-9]{11}\b", 0.95)],
    "EPFMemberID": [
        _india(r"(?i)\b[A-Z]{2}/[A-Z]{3}/\d{7}/\d{3}/\d{7}\b", 0.95),
        _india(r"(?i)\b[A-Z]{2}[A-Z]{3}\d{7}\d{3}\d{7}\b", 0.95),
        _india(r"(?i)\b(?:EPF|PF)[\s_-]?\d{15,22}\b", 0.90),
    ],
    "GSTIN": [_india(r"(?i)\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z][ZDC][0-9A-Z]\b", 0.95)],
    "VehicleNumber": [
        _india(rf"(?i)\b(?:{_STATES_VEHICLE})[ -]?[0-9]{{2}}[ -]?[A-Z]{{1,3}}[ -]?[0-9]{{4}}\b", 0.8),
        _india(r"(?i)\b[0-9]{2}[ -]?BH[ -]?[0-9]{4}[ -]?[A-Z]{2}\b", 0.8),
        _india(rf"(?i)\b(?:{_STATES_VEHICLE})[ -]?VA[ -]?[A-Z]{{2}}[ -]?[0-9]{{4}}\b", 0.8),
        _india(r"(?i)\b[0-9]{3}[ -]?(?:CD|CC|UN)[ -]?[0-9]{4}\b", 0.8),
    ],
    "IPAddress": [
        Rule(r"(?:^|[^0-9])((?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?::(?:6553[0-5]|655[0-2]\d|65[0-4]\d{2}|6[0-4]\d{3}|[1-5]?\d{1,4}))?)(?:$|[^0-9])", 1.0),
        Rule(r"(?i)(?:^|[^0-9A-Fa-f:])((?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,7}:|(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,5}(?::[0-9a-f]{1,4}){1,2}|(?:[0-9a-f]{1,4}:){1,4}(?::[0-9a-f]{1,4}){1,3}|(?:[0-9a-f]{1,4}:){1,3}(?::[0-9a-f]{1,4}){1,4}|(?:[0-9a-f]{1,4}:){1,2}(?::[0-9a-f]{1,4}){1,5}|[0-9a-f]{1,4}:(?::[0-9a-f]{1,4}){1,6}|:(?:(?::[0-9a-f]{1,4}){1,7}|:)|::ffff:\d{1,3}(?:\.\d{1,3}){3})(?:%[0-9A-Za-z._-]+)?(?:$|[^0-9A-Fa-f:])", 1.0),
    ],
    "MacAddress": [Rule(r"(?i)\b[0-9a-f]{2}(?:[:\-][0-9a-f]{2}){5}\b|\b[0-9a-f]{4}(?:\.[0-9a-f]{4}){2}\b", 1.0)],
    "OAuthToken": [
        Rule(r"\bya29\.[a-zA-Z0-9_\-]{50,250}\b", 0.95),
        Rule(r"\b1//[a-zA-Z0-9_\-]{40,200}\b", 0.95),
        Rule(r"\bgh[opur]_[a-zA-Z0-9]{36,255}\b", 0.95),
        Rule(r"\bxox[pbar]-[0-9]{10,13}-[0-9]{10,13}-[a-zA-Z0-9]{24,32}\b", 0.95),
        Rule(r"\beyJ[a-zA-Z0-9_\-]{10,}\.[a-zA-Z0-9_\-=]{10,}\.[a-zA-Z0-9_\-\.=]{3,}\b", 0.90),
    ],
    "Address": [
        Rule(r"(?i)\b\d+\b.{4,60}\b(st|street|ave|avenue|road|rd|drive|dr)\b", 0.8),
        Rule(r"\d{1,4} [a-zA-Z0-9]{1,20}( (street|st|avenue|ave|road|rd|highway|hwy|square|sq|trail|trl|drive|dr|court|ct|park|parkway|pkwy|circle|cir|boulevard|blvd))\W?(\s|$)", 0.8),
    ],
    "ESIC": [_india(r"\b\d{2}[-\s]\d{2}[-\s]\d{6}[-\s]\d{3}[-\s]\d{4}\b", 0.9), _india(r"\b\d{17}\b", 0.6)],
    "RationCard": [_india(rf"(?i)^({_STATES_RATION})[-/]?\d{{10,15}}$", 0.7)],
    "SEBIRegistration": [_india(r"(?i)\b(INZ|INH|INP|INR|INA|INM|INQ)\d{9}\b", 0.95)],
    "BirthDate": [
        Rule(r"\b(0[1-9]|[12]\d|3[01])[\/\-\.](0[1-9]|1[0-2])[\/\-\.](19|20)\d{2}\b|\b(19|20)\d{2}[\/\-\.](0[1-9]|1[0-2])[\/\-\.](0[1-9]|[12]\d|3[01])\b", 1.0, None, True),
    ],
    "Location": [Rule(r"^[-+]?([1-8]?\d(\.\d+)?|90(\.0+)?),\s*[-+]?(180(\.0+)?|((1[0-7]\d)|([1-9]?\d))(\.\d+)?)$", 0.9)],
}


def for_region(rules: Mapping[str, Sequence[Rule]], region: str = "") -> Mapping[str, Sequence[Rule]]:
    """All rules without a region, else the untagged ones and those of the region."""
    if not region:
        return rules
    kept = {label: [r for r in some if r.region is None or r.region == region.lower()] for label, some in rules.items()}
    return {label: some for label, some in kept.items() if some}
