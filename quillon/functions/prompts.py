"""Texts that models and judges are asked, and the requests around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The judge's prompt in the order of its parts.  Both layouts share
# the parts; they differ in the blank lines between them.
JUDGE_HEAD = (
    "You are an expert evaluator for natural language generation systems. Your task is to evaluate the quality of generated responses "
    "using the G-Eval methodology with chain-of-thought reasoning."
)
JUDGE_LENGTH = "Control the Maximum Length to 500 words."
JUDGE_TAIL = """**Instructions:**
1. Analyze the generated response step by step using chain-of-thought reasoning
2. Compare it against the expected answer for the specified criterion
3. Consider both content quality and alignment with the expected answer
4. Provide detailed reasoning for your evaluation
5. Conclude with a single score from 1-5
6. Ignore error in index mismatch, just focus on the content

Please follow this exact format for your response:

**Step-by-step Analysis:**
[Provide detailed chain-of-thought analysis]

**Comparison with Expected Answer:**
[Compare generated response with expected answer]

**Final Assessment:**
[Summarize your evaluation]

**Score:** [Single integer: 1, 2, 3, 4, or 5]"""
# Parts of the question prompt, each line indented by 12 blanks.
QUESTION_INDENT = " " * 12
QUESTION_HEAD = "You are an expert time series analyst. Analyze the provided data and answer the question."
REMOVED = "(removed)"
FIXED_HINT = "<|fixed_hint|>"
#: Greatest number of alternatives that a request may ask for.
MOST_ALTERNATIVES = 5


def judge_prompt(criterion: Column, description: Column, guides: Column, question: Column, answer: Column, response: Column, author: bool = False) -> Column:
    """Prompt of one criterion; ``guides`` is an array of lines.

    The author layout keeps the criterion's name as it is, puts ``Score`` before
    each guide, and sets its parts apart by blank lines.
    """
    name = criterion if author else F.replace(criterion, F.lit("_"), F.lit(" "))
    lines = F.transform(guides, lambda g: F.concat(F.lit("Score "), g)) if author else guides
    gap = "\n\n" if author else "\n"
    return F.concat(
        F.lit(f"{JUDGE_HEAD}{gap}{JUDGE_LENGTH}\n\n**Evaluation Criterion: "), name, F.lit("**\n"), description,
        F.lit("\n\n**Scoring Guidelines:**\n"), F.array_join(lines, "\n"),
        F.lit("\n\n**Question:** "), question, F.lit(f"{gap}**Expected Answer:** "), answer, F.lit(f"{gap}**Generated Response:** "), response,
        F.lit(f"\n\n{JUDGE_TAIL}"),
    )


def question_prompt(start: Column, end: Column, values: Column, local_hints: Column, fixed_hints: Column, question: Column) -> Column:
    """What a model is asked about a window; ``values`` and hints are texts (see ``arrays``)."""
    line = lambda *parts: F.concat(F.lit("\n" + QUESTION_INDENT), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.concat(
        line(QUESTION_HEAD), F.lit("\n"),
        line("### Time Series Data"), line("- **Window:** Steps ", start.cast("string"), " to ", end.cast("string")), line("- **Values (scaled by 100):** ", values), F.lit("\n"),
        line("### Contextual Hints"), line("- **Per-Step Analysis:** ", local_hints), line("- **Overall Summary Hints:** ", fixed_hints), F.lit("\n"),
        line("### Question"), line(question), line(""),
    )


def answer_prompt(answer: Column) -> Column:
    return F.concat(F.lit("Answer: "), answer)


def parse_thinking(value: str) -> bool | None:
    """auto: None, true and false in any case; anything else is an error."""
    known = {"auto": None, "true": True, "false": False}
    if value.lower() not in known:
        raise ValueError("expected auto, true, or false")
    return known[value.lower()]


def thinking_of(c: Column) -> Column:
    """:func:`parse_thinking` of a column."""
    low = F.lower(c)
    known = F.when(low == "auto", F.lit(None).cast("boolean")).when(low == "true", True).when(low == "false", False)
    return known.otherwise(F.raise_error(F.lit("expected auto, true, or false")).cast("boolean"))


#: Alternatives of a request, and samples of a fallback.
FALLBACKS = (0, 20)


def setting_faults(top_logprobs: Column, fallback: Column, bound: Column, readout: bool = False) -> Column:
    """Names of the settings of a judging run that are refused, in order; empty if all are fine.

    Alternatives must be from 0 (1 for a readout) to 5, fallback samples 0 or 20,
    and the bound of missing score mass in [0, 1).  A null is refused.
    """
    fine = {
        "top_logprobs": top_logprobs.between(int(readout), MOST_ALTERNATIVES),
        "fallback_samples": fallback.isin(*FALLBACKS),
        "max_missing_score_mass": (bound >= 0) & (bound < 1) & ~F.isnan(bound),
    }
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in fine.items())), lambda x: x.isNotNull())


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _body(fields: dict[str, object], messages: list[Column]) -> Column:
    """A JSON object of the fields in order; those that are None are left out."""
    columns = [F.lit(v).alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in fields.items() if v is not None]
    return F.to_json(F.struct(columns[0], F.array(*messages).alias("messages"), *columns[1:]))


def request_body(
    model: str, prompt: Column, temperature: float, max_tokens: int, logprobs: bool = False, top_logprobs: int = 0, seed: int = 72, thinking: bool | None = None
) -> Column:
    """Chat request as JSON."""
    if not 0 <= top_logprobs <= MOST_ALTERNATIVES or logprobs and not top_logprobs:
        raise ValueError(f"top_logprobs must be between {int(logprobs)} and {MOST_ALTERNATIVES}")
    asked = {"logprobs": True, "top_logprobs": top_logprobs} if logprobs else {}
    return _body({"model": model, "temperature": temperature, "max_tokens": max_tokens, "seed": seed, **asked, "enable_thinking": thinking}, [_message("user", prompt)])


def readout_body(
    model: str, prompt: Column, judgement: Column, instruction: str, max_tokens: int, top_logprobs: int = 5, seed: int = 72, thinking: bool | None = None
) -> Column:
    """Request for the score of a judgement already given, as a JSON object."""
    if not 1 <= top_logprobs <= MOST_ALTERNATIVES:
        raise ValueError(f"top_logprobs must be between 1 and {MOST_ALTERNATIVES}")
    kind = F.struct(F.lit("json_object").alias("type"))
    fields = {
        "model": model, "temperature": 0.0, "max_tokens": max_tokens, "seed": seed, "logprobs": True, "top_logprobs": top_logprobs, "response_format": kind,
        "enable_thinking": thinking,
    }
    return _body(fields, [_message("user", prompt), _message("assistant", judgement), _message("user", F.lit(instruction))])


def compact_primary(primary: Column) -> Column:
    """Of a response struct what a later fallback needs: the first choice's content, model, fingerprint and usage."""
    choice = F.get(primary["choices"], F.lit(0))
    message = F.struct(F.coalesce(choice["message"]["content"], F.lit("")).alias("content"))
    return F.struct(
        F.array(F.struct(message.alias("message"))).alias("choices"), primary["model"].alias("model"),
        primary["system_fingerprint"].alias("system_fingerprint"), primary["usage"].alias("usage"),
    )


def analysis_items(data: Column) -> Column:
    """Items of a JSON text that is one object or a list of them; a missing question type is ``unknown``."""
    item = "struct<question:string,answer:string,question_type:string,window_range:struct<start:int,`end`:int>>"
    found = F.from_json(data, f"array<{item}>", {"mode": "FAILFAST"})
    return F.transform(
        found,
        lambda x: F.struct(
            x["question"].alias("question"), x["answer"].alias("answer"), x["window_range"]["start"].alias("start_index"), x["window_range"]["end"].alias("end_index"),
            F.coalesce(x["question_type"], F.lit("unknown")).alias("question_type"),
        ),
    )
