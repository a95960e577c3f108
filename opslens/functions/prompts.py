"""Prompt rendering and the rule-based stand-in for a model answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own wording; the placeholders are the contract. Pass other texts to ``render`` at will.
PERSONA = (
    "SYSTEM:\nYou are the {{role}} of the on-call panel. Charter: {{roleCharter}}\n"
    "Answer in JSON with role, errorType, layer, suspectedFiles, confidence, rationale."
)
PERSONA_INPUT = "\n\nUSER:\nPROJECT REQUIREMENT:\n{{projectRequirement}}\n\nSTACK TRACE:\n{{stackTrace}}\n\nCODE:\n{{codeContext}}"
ROOT_CAUSE = (
    "SYSTEM:\nState the root cause. Answer in JSON with cause, evidence, confidence, alternatives.\n\n"
    "USER:\nERROR TYPE: {{agreedErrorType}}\nLAYER: {{primaryLayer}}\nCONFIDENCE: {{swarmConfidence}}\n"
    "DISSENT: {{dissentJson}}\nCODE:\n{{codeChunks}}"
)
TICKET = (
    "SYSTEM:\nWrite the ticket. Answer in JSON with title, description, suspectedFiles, fixSuggestion.\n\n"
    "USER:\nCAUSE: {{cause}}\nLAYER: {{layer}}\nEVIDENCE: {{evidence}}\nALTERNATIVES: {{alternatives}}"
)
PRIORITY = "SYSTEM:\nAnswer P1 or P2 only.\n\nUSER:\nDEFECT: {{description}}\nSCORE: {{score}}"

# The five roles of the panel. The charters are our own short ones.
PERSONAS = {
    "Backend Engineer": "services, transactions, connection pools, interfaces",
    "DevOps Engineer": "runtime, containers, memory, network, rollouts",
    "Frontend Engineer": "browser, rendering, client state",
    "Full Stack Engineer": "request paths across tiers and messaging",
    "System Analyst": "business rules, state machines, requirements",
}

# Answers of the rule-based stand-in, by the word found in the prompt.
STUB_NULL_POINTER = (
    '{"file":"PaymentService.java","method":"process","issue":"Null pointer on parameter paymentId",'
    '"fix":"Add objects requireNonNull check","confidence":0.92}'
)
STUB_TIMEOUT = (
    '{"file":"DatabasePool.java","method":"getConnection","issue":"Connection pool depletion",'
    '"fix":"Increase max pool sizes to 50","confidence":0.85}'
)
STUB_DEFAULT = '{"cause": "UNHANDLED_MOCK_STATE"}'


def render(template: str, **values: Column) -> Column:
    """Substitute ``{{name}}`` in the order given; a value's own braces may be substituted by later names."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(c, F.lit("")))
    return out


def stub_answer(prompt: Column) -> Column:
    return (
        F.when(F.contains(prompt, F.lit("NullPointerException")), STUB_NULL_POINTER)
        .when(F.contains(prompt, F.lit("TimeoutException")), STUB_TIMEOUT)
        .otherwise(STUB_DEFAULT)
    )


def stub_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")
