"""Roles of the columns of an event log, passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class LogSchema:
    """One row per event; ``tiebreak`` makes the order inside a case total."""

    name: str
    case: str
    activity: str
    ts: str
    resource: str
    label: str
    positive: str = "deviant"
    negative: str = "regular"
    dynamic_cat: tuple[str, ...] = ()
    dynamic_num: tuple[str, ...] = ()
    static_cat: tuple[str, ...] = ()
    static_num: tuple[str, ...] = ()
    tiebreak: tuple[str, ...] = ()
    prefix_cap: int = 40
    prefix_fixed: int | None = None
    train_size: int | None = None
    test_size: int | None = None

    @property
    def order(self) -> tuple[str, ...]:
        """Columns that sort the events of a case."""
        return (self.ts, self.activity, *self.tiebreak)

    @property
    def categorical(self) -> tuple[str, ...]:
        return self.dynamic_cat + self.static_cat

    @property
    def numeric(self) -> tuple[str, ...]:
        return self.dynamic_num + self.static_num

    def with_case(self, column: str) -> LogSchema:
        """The same roles with another case column (a prefix id, for instance)."""
        return replace(self, case=column)


# Names of the public logs and of their columns.
_SEPSIS_STATIC = (
    "Diagnose", "DiagnosticArtAstrup", "DiagnosticBlood", "DiagnosticECG", "DiagnosticIC",
    "DiagnosticLacticAcid", "DiagnosticLiquor", "DiagnosticOther", "DiagnosticSputum",
    "DiagnosticUrinaryCulture", "DiagnosticUrinarySediment", "DiagnosticXthorax", "DisfuncOrg",
    "Hypotensie", "Hypoxie", "InfectionSuspected", "Infusion", "Oligurie", "SIRSCritHeartRate",
    "SIRSCritLeucos", "SIRSCritTachypnea", "SIRSCritTemperature", "SIRSCriteria2OrMore",
)
_SEPSIS_NUMERIC = (
    "CRP", "LacticAcid", "Leucocytes", "hour", "day", "month", "timesincemidnight",
    "timesincelast", "timesincestart", "OrderOfEvent", "openCases", "remainingtime",
)
_TRAFFIC_NUMERIC = (
    "expense", "timesincelastevent", "timesincecasestart", "timesincemidnight", "event_nr",
    "month", "weekday", "hour", "open_cases",
)
_LOAN_DYNAMIC = (
    "concept:name", "org:resource", "Action", "CreditScore", "EventOrigin",
    "lifecycle:transition", "Accepted", "Selected",
)
_LOAN_NUMERIC = (
    "FirstWithdrawalAmount", "MonthlyCost", "NumberOfTerms", "OfferedAmount",
    "timesincelastevent", "timesincecasestart", "timesincemidnight", "event_nr", "month",
    "weekday", "hour", "open_cases",
)
_BILLING_DYNAMIC = (
    "Activity", "org:resource", "actOrange", "actRed", "blocked", "Type", "diagnosis", "flagC",
    "flagD", "msgCode", "msgType", "state", "version", "isCancelled", "isClosed", "closeCode",
)
_BILLING_NUMERIC = (
    "msgCount", "timesincelast", "timesincestart", "event_nr", "weekday", "hour", "open_cases",
)


def known_logs() -> dict[str, LogSchema]:
    """Roles of the nine public logs by name."""
    logs = {}
    for i in (1, 2, 3):
        flip = i == 3
        logs[f"sepsis{i}"] = LogSchema(
            f"sepsis{i}", "case", "concept:name", "time:timestamp", "org:group", "label",
            positive="regular" if flip else "deviant", negative="deviant" if flip else "regular",
            dynamic_cat=("concept:name", "org:group"), dynamic_num=_SEPSIS_NUMERIC,
            static_cat=_SEPSIS_STATIC, static_num=("Age",), train_size=400, test_size=100,
        )
    logs["traffic_fines"] = LogSchema(
        "traffic_fines", "case:concept:name", "concept:name", "time:timestamp", "org:resource", "label",
        dynamic_cat=("concept:name", "org:resource", "lastSent", "notificationType", "dismissal"),
        dynamic_num=_TRAFFIC_NUMERIC, static_cat=("article", "vehicleClass"),
        static_num=("amount", "points"), prefix_fixed=10, train_size=20000, test_size=4000,
    )
    for outcome in ("Accepted", "Cancelled", "Refused"):
        name = f"BPIC2017_O_{outcome}"
        logs[name] = LogSchema(
            name, "case:concept:name", "concept:name", "time:timestamp", "org:resource", "label",
            dynamic_cat=_LOAN_DYNAMIC, dynamic_num=_LOAN_NUMERIC,
            static_cat=("case:ApplicationType", "case:LoanGoal"), static_num=("case:RequestedAmount",),
            prefix_cap=20, train_size=10000, test_size=2000,
        )
    for i in (1, 2):
        name = f"hospital_billing_{i}"
        dynamic = tuple(c for c in _BILLING_DYNAMIC if i == 2 or c != "isClosed")
        logs[name] = LogSchema(
            name, "cID", "Activity", "time:timestamp", "org:resource", "label",
            positive=" deviant", dynamic_cat=dynamic, dynamic_num=_BILLING_NUMERIC,
            static_cat=("speciality",), train_size=10000, test_size=2000,
        )
    return logs
