"""Outcome of every rule: category, level, score and the texts shown for it.

``OUTCOMES`` is a small dimension (one row per rule code). Category, level,
score and the number of reasons are fixed values; the texts are ours.
"""

from __future__ import annotations

from typing import NamedTuple


class Outcome(NamedTuple):
    category: str
    level: str
    score: int
    summary: str
    pushback: str | None
    reasons: tuple[str, ...]
    risk_bearing: bool = True


_MUTUAL_EXIT = (
    "Either party may end this Agreement for convenience on thirty (30) days prior written notice, and Client shall "
    "pay for all work completed up to that date."
)
_MUTUAL_RENEWAL = "The term is renewed or extended only by a written agreement signed by both parties."
_PAY_AT_EXPIRY = "When the term ends, Client promptly pays for every service performed and deliverable completed."
_CAPPED_INDEMNITY = "Indemnities are mutual, fault-based and capped at the total fees paid under this Agreement."

OUTCOMES: dict[str, Outcome] = {
    # structural kinds without risk
    "kind_definition": Outcome("OTHER", "NEUTRAL", 10, "Defines a term; creates no exposure by itself.", None, (), False),
    "kind_heading": Outcome("OTHER", "NEUTRAL", 10, "A heading without obligations of its own.", None, (), False),
    "kind_recital": Outcome("OTHER", "NEUTRAL", 10, "Background to the agreement; not binding.", None, (), False),
    "kind_boilerplate": Outcome("OTHER", "NEUTRAL", 10, "Routine administrative provision.", None, (), False),
    # negated duties
    "no_indemnity": Outcome(
        "INDEMNIFICATION", "LOW", 15, "States that no indemnity is owed.", None, ("Indemnification duty is negated",)
    ),
    "bilateral_exit": Outcome(
        "TERMINATION", "LOW", 20, "Holds both parties back from ending the contract.", None,
        ("Restriction binds both parties",),
    ),
    "bilateral_other": Outcome(
        "OTHER", "LOW", 20, "Holds both parties back from a one-sided step.", None, ("Restriction binds both parties",)
    ),
    "mutual_disclaimer": Outcome(
        "LIABILITY", "LOW", 20, "Both parties disclaim indirect damages.", None, ("Liability disclaimer is mutual",)
    ),
    # order of precedence
    "precedence": Outcome(
        "DISPUTE_RESOLUTION", "HIGH", 85,
        "Terms in a purchase order or invoice can displace what was agreed here.",
        "If this Agreement and a purchase order or invoice differ, this Agreement prevails.",
        (
            "Consequence: outside paperwork can override the contract",
            "Imbalance: one side writes the overriding paperwork",
            "No mitigation: no consent is needed for the override",
        ),
    ),
    # indemnity
    "indemnity_negated": Outcome(
        "INDEMNIFICATION", "LOW", 15, "The indemnity is cut back by a negative covenant.", None,
        ("Indemnification duty is negated",),
    ),
    "indemnity_mutual": Outcome(
        "INDEMNIFICATION", "LOW", 30, "Each side answers for its own fault.", None, ("Indemnification is reciprocal",)
    ),
    "indemnity_uncapped": Outcome(
        "INDEMNIFICATION", "HIGH", 92,
        "You alone cover losses and legal bills of the other side, without any limit.",
        "Each party indemnifies the other for third-party claims caused by its gross negligence, up to the fees "
        "received under this Agreement.",
        (
            "Consequence: third-party losses and defense bills fall on you",
            "Imbalance: the duty is one-sided and unlimited",
            "No mitigation: no cap, mutuality or payment condition",
        ),
    ),
    "indemnity_capped": Outcome(
        "INDEMNIFICATION", "MEDIUM", 55, "A broad one-sided indemnity, held in part by a cap.", _CAPPED_INDEMNITY,
        (
            "Consequence: indemnification exposure",
            "Imbalance: the duty is one-sided",
            "Part mitigation: a liability cap exists",
        ),
    ),
    "indemnity_one_sided": Outcome(
        "INDEMNIFICATION", "MEDIUM", 60, "A one-sided indemnity within ordinary legal limits.", _CAPPED_INDEMNITY,
        ("Consequence: indemnification exposure", "Imbalance: the duty is one-sided"),
    ),
    # intellectual property
    "ip_background": Outcome(
        "INTELLECTUAL_PROPERTY", "LOW", 20, "You keep what you owned before the work began.", None,
        ("Background IP stays with its owner",),
    ),
    "ip_unpaid": Outcome(
        "INTELLECTUAL_PROPERTY", "HIGH", 88,
        "Ownership of the work passes at once, whether or not you are paid.",
        "Rights in the Deliverables pass to Client only when Contractor has received full payment of the invoice.",
        (
            "Consequence: ownership of all work product is lost",
            "Imbalance: the transfer does not depend on payment",
            "No mitigation: no payment condition protects the author",
        ),
    ),
    "ip_paid": Outcome(
        "INTELLECTUAL_PROPERTY", "LOW", 25, "Ownership passes once the work is paid for.", None,
        ("IP transfer depends on payment",),
    ),
    "ip_unconditioned": Outcome(
        "INTELLECTUAL_PROPERTY", "MEDIUM", 55, "Ownership passes without a stated link to payment.",
        "Title to the Deliverables passes to Client on receipt of full payment for the milestone.",
        ("Consequence: ownership of IP passes", "No payment condition is stated"),
    ),
    "ip_standard": Outcome("INTELLECTUAL_PROPERTY", "LOW", 20, "Ordinary scope and licensing terms.", None, ()),
    # duration
    "term_forfeiture": Outcome(
        "TERMINATION", "HIGH", 85, "Accrued pay or rights are lost when the term ends.", _PAY_AT_EXPIRY,
        ("Consequence: pay or rights are forfeited at expiry", "Imbalance: only one side forfeits"),
    ),
    "term_extension": Outcome(
        "TERMINATION", "HIGH", 80, "The other side alone may prolong the term.", _MUTUAL_RENEWAL,
        ("Consequence: obligations continue on demand", "Imbalance: one side controls the extension"),
    ),
    "term_rate_freeze": Outcome(
        "PAYMENT_TERMS", "MEDIUM", 55, "Prices stay frozen through extended terms.",
        "Rates are reviewed every year and adjusted by written agreement or published rate card.",
        ("Consequence: rates cannot follow costs", "Imbalance: only one side bears the freeze"),
    ),
    "term_standard": Outcome("OTHER", "LOW", 15, "Says how long the agreement runs.", None, ()),
    # renewal
    "renewal_unilateral": Outcome(
        "TERMINATION", "HIGH", 80, "The other side alone may renew and so lock you in.", _MUTUAL_RENEWAL,
        (
            "Consequence: performance continues on demand",
            "Imbalance: renewal needs no consent from you",
            "No mitigation: the renewal cannot be refused",
        ),
    ),
    "renewal_forfeiture": Outcome(
        "TERMINATION", "HIGH", 85, "Pay or deliverables are lost when the contract is not renewed.", _PAY_AT_EXPIRY,
        ("Consequence: completed work goes unpaid at expiry", "Imbalance: expiry works as a penalty"),
    ),
    "renewal_notice": Outcome(
        "TERMINATION", "MEDIUM", 55, "Rolls over unless a long or one-sided notice is given.",
        "Renewal needs a written agreement, or either party may opt out on thirty (30) days prior written notice.",
        ("Consequence: rollover locks in the obligations", "Imbalance: the notice to leave is long or one-sided"),
    ),
    "renewal_customary": Outcome("TERMINATION", "LOW", 20, "Customary renewal with ordinary notice.", None, ()),
    # termination
    "exit_negated": Outcome(
        "TERMINATION", "LOW", 20, "Termination without cause is restricted.", None, ("Termination is restricted",)
    ),
    "exit_forfeiture": Outcome(
        "TERMINATION", "HIGH", 85, "The client may leave at will and keep unpaid work in progress.", _MUTUAL_EXIT,
        (
            "Consequence: pay for work in progress is lost",
            "Imbalance: one side may leave and cause forfeiture",
            "No mitigation: no notice period or right to cure",
        ),
    ),
    "exit_with_notice": Outcome(
        "TERMINATION", "MEDIUM", 55, "One-sided exit with notice, yet work may be forfeited.", _MUTUAL_EXIT,
        ("Consequence: work may be forfeited", "Part mitigation: a notice or cure period exists"),
    ),
    "exit_convenience": Outcome(
        "TERMINATION", "MEDIUM", 50, "Only the client may leave for convenience.", _MUTUAL_EXIT,
        ("Consequence: the engagement may end one-sidedly", "Imbalance: only the client may leave for convenience"),
    ),
    "exit_mutual": Outcome("TERMINATION", "LOW", 20, "Either side may leave with notice or after cure.", None, ()),
    "exit_standard": Outcome("TERMINATION", "LOW", 20, "Ordinary termination procedure.", None, ()),
    # payment
    "payment_delayed": Outcome(
        "PAYMENT_TERMS", "MEDIUM", 65, "Long payment cycles or discretionary withholding strain cash flow.",
        "Invoices are payable within thirty (30) days; undisputed parts are paid at once.",
        ("Consequence: cash flow suffers from late payment", "Imbalance: payment may be withheld at discretion"),
    ),
    "payment_standard": Outcome("PAYMENT_TERMS", "LOW", 20, "Ordinary payment terms.", None, ()),
    # tenancy
    "tenancy_entry": Outcome(
        "MISC", "HIGH", 90, "The landlord may enter without warning.",
        "The landlord enters only on twenty-four (24) hours written notice in business hours, emergencies excepted.",
        (
            "Consequence: quiet enjoyment is lost",
            "Imbalance: entry is the landlord's choice alone",
            "No mitigation: no notice is required",
        ),
    ),
    "tenancy_deposit": Outcome(
        "PAYMENT_TERMS", "MEDIUM", 60, "The deposit may be used up for ordinary wear.",
        "Deposit deductions are limited to proven damage beyond ordinary wear, with itemized receipts.",
        ("Consequence: the deposit is lost to ordinary wear", "Imbalance: the landlord alone decides deductions"),
    ),
    "tenancy_standard": Outcome("MISC", "LOW", 20, "Ordinary tenancy covenant.", None, ()),
    # everything else
    "default_dispute": Outcome("DISPUTE_RESOLUTION", "LOW", 20, "Customary commercial provision.", None, ()),
    "default_other": Outcome("OTHER", "LOW", 20, "Customary commercial provision.", None, ()),
}

COUNTER_TEXTS: dict[str, str] = {
    "ip": OUTCOMES["ip_unpaid"].pushback,
    "precedence": OUTCOMES["precedence"].pushback,
    "indemnity": OUTCOMES["indemnity_uncapped"].pushback,
    "exit": _MUTUAL_EXIT,
    "renewal": _MUTUAL_RENEWAL,
    "payment": OUTCOMES["payment_delayed"].pushback,
    "access": "Audits and inspections take place in business hours on seven (7) business days written notice.",
    "default": "Obligations are mutual and reasonable, and are capped at the total fees paid under this Agreement.",
}

RELATION_TEXTS: dict[str, str] = {
    "overrides": "takes precedence over",
    "mitigates": "is softened by protective terms of",
    "limits": "is subject to",
    "expands": "adds to",
    "unrelated": "mentions",
}

COUNSEL_QUESTIONS: dict[str, list[str]] = {
    "brief": [
        "Can transfer of intellectual property wait until every invoice is paid?",
        "Can both sides have a 30-day notice period, without forfeiture of unbilled work?",
        "Can the indemnity be capped at the fees collected under this agreement?",
        "Which acceptance criteria would stop fees from being withheld at discretion?",
    ],
    "lease": [
        "Does tenancy law override a waiver of 24-hour notice before landlord entry?",
        "Can the automatic rent increase be limited to the consumer price index?",
        "May the landlord deduct ordinary wear from the deposit?",
        "Which remedies exist if heating or plumbing is not repaired within a day?",
    ],
    "nda": [
        "Are independently developed and previously known facts excluded from confidentiality?",
        "Can disclosure to lawyers and financial advisers be permitted?",
        "Is a 2-year survival period enough for trade secrets?",
        "What notice is due when disclosure is compelled by a court?",
    ],
    "services": [
        "Can every transfer of intellectual property depend on full payment?",
        "Can both sides have a 30-day notice period, without forfeiture of work in progress?",
        "Can the contractor's indemnity be capped at the fees collected?",
        "Which acceptance criteria would stop fees from being withheld at discretion?",
    ],
}

SCENARIO_PROMPTS: dict[str, list[tuple[str, str]]] = {
    "lease": [
        ("lease_entry", "May the landlord enter my apartment without 24-hour notice?"),
        ("lease_rent", "How does the automatic rent escalation work when the initial lease term ends?"),
        ("lease_deposit", "May ordinary wear be deducted from my deposit when I move out?"),
    ],
    "nda": [
        ("nda_lawyer", "May I show this agreement to my lawyer and accountant?"),
        ("nda_term", "What happens to trade secrets after the 2-year survival period?"),
        ("nda_subpoena", "What must I do when a court compels disclosure?"),
    ],
    "services": [
        ("free_cancel", "What happens to unpaid hours if the client cancels the contract midway?"),
        ("free_ip", "May I reuse code that I wrote before this contract?"),
        ("free_payment", "What can I do when payment is more than 30 days late?"),
    ],
}
