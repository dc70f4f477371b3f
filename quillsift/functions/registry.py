"""Labels, their tiers and domains, and the labels whose weight is merged with the column's."""

# Label -> (tier, domain). Labels without a tier of their own count as Tier3; Password has no domain.
LABELS = {
    "ABHANumber": ("Tier2", "NationalID"),
    "Address": ("Tier3", "Personal"),
    "AdharcardNumber": ("Tier1", "NationalID"),
    "BankAccountNumber": ("Tier3", "Banking"),
    "BirthDate": ("Tier3", "Personal"),
    "CIFNumber": ("Tier3", "Banking"),
    "CIN": ("Tier1", "Corporate"),
    "CVV": ("Tier3", "Banking"),
    "ChequeNumber": ("Tier3", "Banking"),
    "CreditCard": ("Tier1", "Banking"),
    "DematAccountNumber": ("Tier2", "Banking"),
    "DrivingLicenceNumber": ("Tier2", "NationalID"),
    "EPFMemberID": ("Tier2", "Employment"),
    "ESIC": ("Tier3", "Employment"),
    "Email": ("Tier1", "Personal"),
    "FASTagID": ("Tier3", "Transport"),
    "GSTIN": ("Tier1", "Corporate"),
    "Gender": ("Tier3", "Personal"),
    "IFSC": ("Tier1", "Banking"),
    "IPAddress": ("Tier1", "Digital"),
    "InsurancePolicyNumber": ("Tier3", "Insurance"),
    "LoanAccountNumber": ("Tier3", "Lending"),
    "Location": ("Tier3", "Digital"),
    "MICRCode": ("Tier3", "Banking"),
    "MacAddress": ("Tier1", "Digital"),
    "Name": ("Tier3", "Personal"),
    "Nationality": ("Tier3", "NationalID"),
    "OAuthToken": ("Tier3", "Digital"),
    "PANNumber": ("Tier1", "NationalID"),
    "PassportNumber": ("Tier2", "NationalID"),
    "Password": ("Tier3", None),
    "Phone": ("Tier2", "Personal"),
    "RationCard": ("Tier3", "NationalID"),
    "SEBIRegistration": ("Tier2", "Corporate"),
    "TAN": ("Tier2", "Corporate"),
    "UAN": ("Tier3", "Employment"),
    "UPIID": ("Tier1", "Banking"),
    "Username": ("Tier3", "Digital"),
    "VehicleNumber": ("Tier1", "Transport"),
    "VoterID": ("Tier3", "NationalID"),
}

# Labels whose finding takes the mean of value and column weight.
MERGED = frozenset({
    "ABHANumber", "AdharcardNumber", "BankAccountNumber", "CIFNumber", "CIN", "ChequeNumber", "CreditCard", "DematAccountNumber", "DrivingLicenceNumber",
    "EPFMemberID", "ESIC", "FASTagID", "GSTIN", "IFSC", "InsurancePolicyNumber", "LoanAccountNumber", "MICRCode", "PANNumber", "PassportNumber", "Phone",
    "RationCard", "SEBIRegistration", "TAN", "UAN", "UPIID", "VehicleNumber", "VoterID",
})


def tier(label: str) -> str:
    return LABELS.get(label, ("Tier3", None))[0]


def domain(label: str) -> str | None:
    return LABELS.get(label, ("Tier3", None))[1]


def confidence(weight: float) -> str:
    """Low below 0.4, Medium below 0.7, else High."""
    return "Low" if weight < 0.4 else "Medium" if weight < 0.7 else "High"


ICONS = {"High": "🔴", "Medium": "🟡", "Low": "🔵"}
