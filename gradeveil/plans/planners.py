"""Decision lists over a form's elements: which action is next, or how a proposed action is to be corrected.

Elements are an array of structs (id, role, label, bounds, state) in the order of the page; actions are structs of type,
elementId, direction, amount, milliseconds and message.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeveil.functions.columns import bound, first_match

ACTION = "struct<type:string,elementId:string,direction:string,amount:int,milliseconds:int,message:string>"

# Words in tasks, on controls and in messages.
TASK_TERMS = ["submit", "submitting", "confirm", "continue", "proceed", "finish", "complete", "enroll", "register", "save", "apply"]
BUTTON_TERMS = [*TASK_TERMS, "next"]
STRONG_TERMS = ["submit", "submitting", "enroll", "register", "save", "apply", "finish", "complete"]
FILL_TERMS = ["fill", "enter", "type", "write", "provide", "input"]
COMPLETION_TERMS = ["complete", "completed", "submitted", "success", "successful", "finished", "done"]
PREREQUISITE_TERMS = ["agree", "accept", "consent", "confirm", "acknowledge", "certif", "declaration", "terms", "privacy"]
CONFIRMED_TITLE = r"(?i)\b(?:enrollment|form|application|registration|transfer\s+request)\s+(?:submitted|completed)\s+successfully\b"
SUBMITTED = "The page reports successful form submission."
FINISHED = "Form action completed; inspect the page result."
AMBIGUOUS = "Safe structural progress is impossible without a unique sanitized control."
PLACEHOLDER = r"^\[REDACTED:[A-Z0-9_-]{2,40}\]$"


def has_term(text: Column, terms: list[str]) -> Column:
    """Whether a text has one of the terms as a word; terms that end in f are beginnings of words."""
    stems = [t for t in terms if t.endswith("f")]
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.exists(words, lambda w: w.isin(terms) | (w.rlike("^(?:" + "|".join(stems) + ")") if stems else F.lit(False)))


def terminal(e: Column) -> Column:
    label = F.coalesce(e["label"], F.lit(""))
    return (e["role"] == "button") & (label != "") & ~label.rlike(PLACEHOLDER) & has_term(label, BUTTON_TERMS)


def submit_like(e: Column) -> Column:
    return terminal(e) & ~e["state"]["disabled"]


def prerequisite_label(e: Column) -> Column:
    label = F.coalesce(e["label"], F.lit(""))
    return (label != "") & ~label.rlike(PLACEHOLDER) & has_term(label, PREREQUISITE_TERMS)


def pending(e: Column) -> Column:
    return (e["role"] == "checkbox") & ~e["state"]["disabled"] & ~e["state"]["checked"] & (e["state"]["required"] | prerequisite_label(e))


def fields_complete(elements: Column) -> Column:
    public = F.filter(elements, lambda e: e["role"].isin("textbox", "combobox") & F.contains(F.lower(e["label"]), F.lit("[public]")))
    return (F.size(public) > 0) & F.forall(public, lambda e: F.contains(F.lower(e["label"]), F.lit("[filled]")))


def _action(type_: str, element: Column | None = None, **fields) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    value = lambda name, kind: F.lit(fields[name]).cast(kind) if name in fields else none(kind)
    return F.struct(F.lit(type_).alias("type"), (element if element is not None else none("string")).alias("elementId"), value("direction", "string").alias("direction"), value("amount", "int").alias("amount"), value("milliseconds", "int").alias("milliseconds"), value("message", "string").alias("message"))


def click(element_id: Column) -> Column:
    return _action("click", element_id)


def scroll() -> Column:
    return _action("scroll", direction="down", amount=450)


def done(message: str) -> Column:
    return _action("done", message=message)


def preceding_prerequisite(elements: Column, target_id: Column) -> Column:
    """The id of the closest pending prerequisite before a target and not below its centre (4 tolerance), or null."""
    place = F.array_position(F.transform(elements, lambda e: e["id"]), target_id).cast("int")
    centre = lambda e: e["bounds"]["y"] + e["bounds"]["height"] / 2
    limit = centre(F.try_element_at(elements, place)) + 4
    before = F.filter(F.slice(elements, 1, F.greatest(place - 1, F.lit(0))), lambda e: pending(e) & (centre(e) <= limit))
    return F.try_element_at(before, F.lit(-1))["id"]


def _first(elements: Column) -> Column:
    return F.try_element_at(elements, F.lit(1))["id"]


def form_action(task: Column, title: Column, elements: Column) -> Column:
    """The next action of an unambiguous submit task, or null where a person or a model has to decide."""
    controls = ["textbox", "checkbox", "radio", "combobox", "button"]
    idle = ~F.exists(elements, lambda e: e["role"].isin(controls) & ~e["state"]["disabled"])

    def decide(found: Column) -> Column:
        waiting, submits = found["waiting"], found["submits"]
        target = _first(submits)
        return first_match(
            [
                (~has_term(task, TASK_TERMS), F.lit(None).cast(ACTION)),
                (F.coalesce(title.rlike(CONFIRMED_TITLE), F.lit(False)) & idle, done(SUBMITTED)),
                (has_term(task, FILL_TERMS) & ~fields_complete(elements), F.lit(None).cast(ACTION)),
                (F.size(waiting) > 0, click(_first(waiting))),
                (F.size(submits) == 1, click(target)),
                (F.size(submits) == 0, scroll()),
            ]
        )

    return bound(F.struct(F.filter(elements, pending).alias("waiting"), F.filter(elements, submit_like).alias("submits")), decide)


def structural_action(task: Column, elements: Column) -> Column:
    """The fallback plan: one step towards the only control in question, or done where there are several."""

    def decide(found: Column) -> Column:
        waiting, submits, ended = found["waiting"], found["submits"], found["ended"]
        return first_match(
            [
                ((F.size(waiting) > 1) | (F.size(submits) > 1), done(AMBIGUOUS)),
                (F.size(waiting) == 1, click(_first(waiting))),
                (F.size(submits) == 1, click(_first(submits))),
                (F.size(ended) == 1, _action("wait", milliseconds=400)),
                (has_term(task, TASK_TERMS), scroll()),
            ],
            done(AMBIGUOUS),
        )

    ended = F.filter(elements, lambda e: terminal(e) & e["state"]["disabled"])
    return bound(F.struct(F.filter(elements, pending).alias("waiting"), F.filter(elements, submit_like).alias("submits"), ended.alias("ended")), decide)


def guarded_action(task: Column, elements: Column, action: Column) -> Column:
    """A proposed action, corrected where a form's preconditions are not met."""

    def decide(found: Column) -> Column:
        waiting, submits, ended = found["waiting"], found["submits"], found["ended"]
        fill, strong = has_term(task, FILL_TERMS), has_term(task, STRONG_TERMS)
        target = F.try_element_at(F.filter(elements, lambda e: e["id"] == action["elementId"]), F.lit(1))
        is_click = (action["type"] == "click") & action["elementId"].isNotNull()
        one, none = F.size(submits) == 1, F.size(submits) == 0
        submit, end = _first(submits), _first(ended)
        before_submit = preceding_prerequisite(elements, submit)
        to_submit = click(F.coalesce(before_submit, submit))
        before_end = preceding_prerequisite(elements, end)
        before_target = preceding_prerequisite(elements, action["elementId"])
        finished = (action["type"] != "done") & strong & ~fill & none & (F.size(ended) == 1)
        consent = (target["role"] == "checkbox") & target["state"]["checked"] & ~target["state"]["disabled"] & (target["state"]["required"] | has_term(target["label"], PREREQUISITE_TERMS)) & ~fill
        chosen = action["type"].isin("input", "select") & (target["role"] == "combobox") & F.contains(F.lower(target["label"]), F.lit("[filled]"))
        early = (action["type"] == "done") & ~fill & one & ~has_term(action["message"], COMPLETION_TERMS)
        yes = lambda c: F.coalesce(c, F.lit(False))
        return first_match(
            [
                (~has_term(task, TASK_TERMS), action),
                (yes(finished & before_end.isNotNull()), click(before_end)),
                (yes(finished & (F.size(waiting) > 0)), action),
                (yes(finished), done(FINISHED)),
                (yes(is_click & target.isNull()), action),
                (yes(is_click & submit_like(target) & before_target.isNotNull()), click(before_target)),
                (yes(is_click & submit_like(target)), action),
                (yes(is_click & consent & one), click(submit)),
                (yes(is_click & consent & none & (F.size(ended) == 0) & strong), scroll()),
                (yes(is_click & ~fill & one & pending(target)), action),
                (yes(is_click & ~fill & one), to_submit),
                (yes(chosen & (F.size(waiting) > 0)), click(_first(waiting))),
                (yes(chosen & one), click(submit)),
                (yes(chosen), scroll()),
                (yes(early), to_submit),
            ],
            action,
        )

    ended = F.filter(elements, lambda e: terminal(e) & e["state"]["disabled"])
    return bound(F.struct(F.filter(elements, pending).alias("waiting"), F.filter(elements, submit_like).alias("submits"), ended.alias("ended")), decide)


def serving_route(capacity: Column, fast: Column, fallback: Column, ready: Column, blocked: Column, outcome: Column, output_valid: Column) -> Column:
    """What a request is answered with, from a log: a route or a status. outcome: of the model call (ok, unavailable,
    timeout, circuit_open, invalid, context_limit)."""
    fall = F.when(fallback, "structural")
    route = first_match(
        [
            (~capacity, "503"),
            (fast, "fast"),
            (~ready | blocked, F.coalesce(fall, F.lit("503"))),
            (outcome == "context_limit", "503"),
            (outcome.isin("unavailable", "timeout", "circuit_open"), F.coalesce(fall, F.lit("503"))),
            (outcome == "invalid", F.coalesce(fall, F.lit("502"))),
        ],
        "model",
    )
    return F.when(route.rlike("^5") | F.coalesce(output_valid, F.lit(False)), route).otherwise("502")


# Roles that a step can act on.
ACTIONABLE = ["button", "link", "textbox", "checkbox", "radio", "combobox", "option", "scroll-region"]


def needs_picture(elements: Column, width: Column, height: Column, edge: int = 960) -> Column:
    """Whether a model has to see the picture: it is small enough, or no element can be acted on."""
    return (F.greatest(width, height) <= edge) | ~F.exists(elements, lambda e: e["role"].isin(ACTIONABLE))


def canvas_tier(requested: Column, detector_available: Column, regions: Column) -> Column:
    """How a canvas is masked: blind masks need a detector that finds text, else a person has to look."""
    blind = (requested == "dbnet-blind-mask") & F.coalesce(detector_available, F.lit(False)) & (F.coalesce(regions, F.lit(0)) > 0)
    return first_match([(requested == "visual-redaction", "visual-redaction"), (blind, "dbnet-blind-mask")], "manual-escalation")
