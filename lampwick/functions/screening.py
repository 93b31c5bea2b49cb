"""Column expressions that screen text: personal data, secrets, prompt injection, safety, input checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists, in the order in which they apply.
PII_PATTERNS = (
    r"\d{17}[\dXx]",
    r"1[3-9]\d{9}",
    r"\d{16,19}",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
)
SENSITIVE_WORDS = ("密码", "password", "secret", "密钥", "key", "token", "access_token", "api_key", "api_secret")
INJECTION_PATTERNS = (
    r"ignore.*previous.*instructions?",
    r"forget.*everything",
    r"disregard.*above",
    r"ignore.*above.*instructions?",
    r"you.*are.*now",
    r"pretend.*you.*are",
    r"act.*as.*if",
    r"roleplay.*as",
    r"system.*prompt",
    r"system.*message",
    r"system.*instruction",
    r"output.*only",
    r"print.*only",
    r"respond.*only",
    r"\[INST\]",
    r"\[/INST\]",
    r"<\|im_start\|>",
    r"<\|im_end\|>",
    r"base64.*decode",
    r"hex.*decode",
    r"rot13.*decode",
)
CONTROL_TOKENS = ("[INST]", "[/INST]", "<|im_start|>", "<|im_end|>")
REMOVED_PHRASES = (r"(?i)ignore.*previous.*instructions?", r"(?i)forget.*everything")
TOXIC_WORDS = ("hate", "violence", "harassment", "self-harm", "sexual", "仇恨", "暴力", "骚扰", "自残", "色情")
VIOLENT_WORDS = ("kill", "murder", "attack", "bomb", "weapon", "杀死", "谋杀", "攻击", "炸弹", "武器")
SELF_HARM_WORDS = ("suicide", "self-harm", "cut", "overdose", "自杀", "自残", "割腕", "过量")
FILTERED = "[输入已过滤]"
SCREENED_FIELDS = ("ocrData", "input", "userInput", "question")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _may_hold(pattern: str) -> Callable[[Column], Column]:
    """A cheap test that a text with personal data by this pattern passes: an at sign, or a digit."""
    return (lambda t: t.contains("@")) if "@" in pattern else (lambda t: t.rlike("[0-9]"))


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _said(text: Column, test: Column) -> Column:
    """false for null and empty texts."""
    return F.coalesce(test, F.lit(False)) & F.coalesce(text != "", F.lit(False))


def has_words(text: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the words, anywhere ("execute" holds "cut")."""
    return _said(text, let(F.lower(text), lambda low: any_of([low.contains(w) for w in words])))


def contains_pii(text: Column) -> Column:
    found = lambda t: any_of([_may_hold(p)(t) & t.rlike(p) for p in PII_PATTERNS])
    return _said(text, let(text, found))


def contains_sensitive(text: Column) -> Column:
    return has_words(text, SENSITIVE_WORDS)


def remove_pii(text: Column) -> Column:
    step = lambda t, p: let(t, lambda x: F.when(_may_hold(p)(x), F.regexp_replace(x, p, "[PII_REMOVED]")).otherwise(x))
    return reduce(step, PII_PATTERNS, text)


def redact_sensitive(text: Column) -> Column:
    """``word: value`` or ``word=value`` becomes ``word:[REDACTED]``, word by word in list order."""
    gone = lambda t, w: F.regexp_replace(t, rf"(?i){w}[:=]\s*\S+", f"{w}:[REDACTED]")
    return reduce(lambda t, w: let(t, lambda x: F.when(F.lower(x).contains(w), gone(x, w)).otherwise(x)), SENSITIVE_WORDS, text)


def escape_special(text: Column) -> Column:
    pairs = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def filter_content(text: Column) -> Column:
    return escape_special(redact_sensitive(remove_pii(text)))


def matched_injection(text: Column) -> Column:
    """The first pattern found, null if none is. A pattern is only tried where the word that it begins with is there."""
    begins = {p: re.sub(r"\\(.)", r"\1", p.split(".*")[0]).lower() for p in INJECTION_PATTERNS}
    return let(F.lower(text), lambda low: F.coalesce(*(F.when(low.contains(begins[p]) & text.rlike(f"(?i){p}"), F.lit(p)) for p in INJECTION_PATTERNS)))


def sanitize_injection(text: Column) -> Column:
    plain = reduce(lambda t, w: F.replace(t, F.lit(w), F.lit("")), CONTROL_TOKENS, text)
    return F.trim(reduce(lambda t, p: F.regexp_replace(t, p, ""), REMOVED_PHRASES, plain))


def special_ratio(text: Column) -> Column:
    """Characters that are neither letters, digits nor white space, as a part of all."""
    n = F.length(text)
    return F.try_divide(F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}\s]", "")).cast("double"), n.cast("double"))


def validate_input(text: Column, least: int = 1, most: int = 10_000, strict: bool = True) -> Column:
    """struct(valid, issue, validated): the first check that fails gives the issue."""
    unsafe = contains_pii(text) | contains_sensitive(text)
    filtered = text if strict else filter_content(text)
    issue = (
        F.when(text.isNull(), "EMPTY")
        .when(F.length(text) > most, "TOO_LONG")
        .when(F.length(text) < least, "TOO_SHORT")
        .when(matched_injection(text).isNotNull(), "PROMPT_INJECTION")
        .when(F.lit(strict) & unsafe, "SENSITIVE_CONTENT")
        .when(F.coalesce(special_ratio(filtered), F.lit(1.0)) > 0.5, "BAD_FORMAT")
    )
    validated = escape_special(filtered) if strict else filtered
    return let(issue, lambda i: F.struct(i.isNull().alias("valid"), i.alias("issue"), F.when(i.isNull(), validated).alias("validated")))


def sanitize_context(context: Column) -> Column:
    """A map with the screened fields replaced by their validated text, or by FILTERED."""

    def one(key: Column, value: Column) -> Column:
        checked = validate_input(value)
        return F.when(key.isin(*SCREENED_FIELDS) & value.isNotNull(), F.coalesce(checked["validated"], F.lit(FILTERED))).otherwise(value)

    return F.transform_values(context, one)


def toxicity(text: Column) -> Column:
    """A tenth for each toxic word that is there, half more from two on, 1 at most."""
    hits = let(F.lower(F.coalesce(text, F.lit(""))), lambda low: reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in TOXIC_WORDS)))
    share = lambda n: F.least(F.lit(1.0), n / len(TOXIC_WORDS))
    return let(hits, lambda n: F.when(n > 1, F.least(F.lit(1.0), share(n) * 1.5)).otherwise(share(n)))


def safety_columns(text: Column) -> dict[str, Column]:
    """toxicity_score, toxic, violence, self_harm, safe, categories."""
    score = toxicity(text)
    toxic, violent, harm = score > 0.5, has_words(text, VIOLENT_WORDS), has_words(text, SELF_HARM_WORDS)
    named = F.filter(F.array(F.when(toxic, "TOXICITY"), F.when(violent, "VIOLENCE"), F.when(harm, "SELF_HARM")), lambda c: c.isNotNull())
    return {"toxicity_score": score, "toxic": toxic, "violence": violent, "self_harm": harm, "safe": ~(toxic | violent | harm), "categories": named}
