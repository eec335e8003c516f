"""Prompt relations, code extraction and overlap scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PERSONA = "As a senior Python engineer with expertise in algorithms and data structures, complete the following function according to its specification:\n\n"
FORMAL = "    [Specification]\n    The function must satisfy the following requirements:\n\n"
FILLERS = (r"\bPlease\b", r"\bNote that\b", r"\bNote:\b", r"\bRemember\b", r"\bMake sure\b", r"\bYou should\b", r"\bDon't forget\b", r"\bKeep in mind\b", r"\bfor example\b,?\s*")
STOPWORDS = ("the", "a", "an", "is", "it", "of", "to", "and", "or", "in", "that", "this", "with", "for", "are", "be", "as", "from")
PUNCTUATION = ".,;:()[]"
RELATIONS = ("original", "persona", "formal", "reorder", "terse")

#: Before the first line of examples.
EXAMPLES = r"(?<=\n)(?=[ \t]*>>>)"
FENCE = r"(?s)```(?:python)?\s*(.*?)```"
DOCSTRING = r'(?s)"""(.*?)"""'


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used; nested uses would otherwise multiply the generated code."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def split_docstring(prompt: Column) -> Column:
    """(signature, description, examples) of a prompt. Lines end with a newline; a prompt without docstring is all signature. Lines are found by position, so prompts may
    have any number of them."""

    def line(x: Column) -> Column:
        """x: the prompt and what stands before the first quotes. The line of these begins after the last newline before them."""
        began = F.length(x["head"]) - F.length(F.substring_index(x["head"], "\n", -1))
        tail = F.substring(x["prompt"], began + 1, F.length(x["prompt"]))
        return let(F.struct(F.substring(x["prompt"], F.lit(1), began).alias("before"), tail.alias("tail"), F.substring_index(tail, "\n", 1).alias("line")), parts)

    def parts(x: Column) -> Column:
        quote = F.when(F.contains(x["line"], F.lit('"""')), F.lit('"""')).otherwise(F.lit("'''"))
        whole = F.substring(x["tail"], F.lit(1), F.length(x["line"]) + 1)  # with its newline, if it has one
        rest = F.substring(x["tail"], F.length(x["line"]) + 2, F.length(x["tail"]))
        return let(F.struct(x["before"].alias("before"), whole.alias("line"), rest.alias("rest"), quote.alias("quote"), F.instr(x["line"], quote).alias("at")), opened)

    def opened(x: Column) -> Column:
        after = strip(F.substring(x["line"], x["at"] + 3, F.length(x["line"])))
        return let(F.struct(*[x[c].alias(c) for c in ("before", "line", "rest", "quote", "at")], after.alias("after")), divided)

    def divided(x: Column) -> Column:
        inline = (x["after"] != "") & (x["after"] != x["quote"])
        signature = F.when(inline, F.concat(x["before"], F.substring(x["line"], F.lit(1), x["at"] + 2), F.lit("\n"))).otherwise(F.concat(x["before"], x["line"]))
        body = F.when(inline, F.concat(x["after"], F.lit("\n"), x["rest"])).otherwise(x["rest"])
        return let(F.struct(signature.alias("signature"), F.split(F.concat(F.lit("\n"), body), EXAMPLES, 2).alias("cut")), exampled)

    def exampled(x: Column) -> Column:
        description = F.get(x["cut"], F.lit(0))
        return F.struct(
            x["signature"].alias("signature"),
            F.substring(description, F.lit(2), F.length(description)).alias("description"),
            F.coalesce(F.get(x["cut"], F.lit(1)), F.lit("")).alias("examples"),
        )

    double, single = F.substring_index(prompt, '"""', 1), F.substring_index(prompt, "'''", 1)
    head = F.when(F.length(double) <= F.length(single), double).otherwise(single)
    none = F.struct(prompt.alias("signature"), F.lit("").alias("description"), F.lit("").alias("examples"))
    return F.when(F.length(head) < F.length(prompt), let(F.struct(prompt.alias("prompt"), head.alias("head")), line)).otherwise(none)


def relation(prompt: Column, name: str) -> Column:
    """The prompt as the named relation words it; unknown names raise ValueError."""
    if name == "original":
        return prompt
    if name == "persona":
        return F.concat(F.lit(PERSONA), prompt)
    if name == "formal":
        return let(split_docstring(prompt), lambda p: F.concat(p["signature"], F.lit(FORMAL), p["description"], p["examples"]))
    if name == "reorder":
        return let(split_docstring(prompt), lambda p: F.when(p["examples"] != "", F.concat(p["signature"], p["examples"], p["description"])).otherwise(prompt))
    if name == "terse":
        for filler in FILLERS:
            prompt = F.regexp_replace(prompt, f"(?i){filler}", "")
        return F.regexp_replace(prompt, r"\n{3,}", "\n\n")
    raise ValueError(f"unknown relation: {name!r}")


def relations(prompt: Column, names: Sequence[str] = RELATIONS) -> Column:
    """A map from relation to prompt."""
    return F.create_map(*[x for name in names for x in (F.lit(name), relation(prompt, name))])


def extract_body(raw: Column, entry_point: Column) -> Column:
    """A completion's code: the first fenced block if any, from the line of the entry point's definition if there is one."""
    code = F.when(raw.rlike(FENCE), F.regexp_extract(raw, FENCE, 1)).otherwise(raw)
    pattern = F.concat(F.lit(r"(?s)(def\s+\Q"), entry_point, F.lit(r"\E\s*\(.*)"))
    found = F.call_function("regexp_extract", code, pattern, F.lit(1))
    return F.when(found != "", found).otherwise(code)


def assemble(prompt: Column, body: Column) -> Column:
    """The program to run: a body without a definition follows the prompt."""
    return F.when(body.rlike(r"^\s*def\s+"), body).otherwise(F.concat(prompt, body))


def test_driver(test: Column, entry_point: Column) -> Column:
    return F.concat(test, F.lit("\ncheck("), entry_point, F.lit(")\n"))


def words(x: Column) -> Column:
    return F.filter(F.split(strip(x), r"\s+"), lambda w: w != "")


def _precision(reference: Column, hypothesis: Column) -> Column:
    """The share of the hypothesis's entries that the reference has too; 0 without entries. One sorted pass over both: an entry of the reference comes before
    equal ones of the hypothesis."""
    start = F.struct(F.lit(None).cast("string").alias("seen"), F.lit(0).alias("hits"))

    def step(state: Column, x: Column) -> Column:
        seen = F.when(x["own"] == 0, x["w"]).otherwise(state["seen"])
        return F.struct(seen.alias("seen"), (state["hits"] + F.when((x["own"] == 1) & x["w"].eqNullSafe(state["seen"]), 1).otherwise(0)).alias("hits"))

    def share(x: Column) -> Column:
        marked = lambda side, own: F.transform(x[side], lambda w: F.struct(w.alias("w"), F.lit(own).alias("own")))
        hits = F.aggregate(F.sort_array(F.concat(marked("r", 0), marked("h", 1))), start, step, lambda state: state["hits"])
        return F.when(F.size(x["h"]) == 0, 0.0).otherwise(hits / F.size(x["h"]))

    return let(F.struct(F.array_distinct(reference).alias("r"), hypothesis.alias("h")), share)


def unigram_precision(reference: Column, hypothesis: Column) -> Column:
    """The share of the hypothesis's words that the reference has; 0 without words."""
    return _precision(words(F.lower(reference)), words(F.lower(hypothesis)))


def bigrams(x: Column) -> Column:
    """Pairs of neighbouring words."""
    none = F.array().cast("array<string>")
    pairs = lambda t: F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return let(words(x), lambda t: F.when(F.size(t) < 2, none).otherwise(pairs(t)))


def bigram_precision(reference: Column, hypothesis: Column) -> Column:
    return _precision(bigrams(F.lower(reference)), bigrams(F.lower(hypothesis)))


def completeness(docstring: Column, spec: Column) -> Column:
    """The share of the docstring's long words, no stopwords, that the spec contains anywhere; 1 if it has none."""
    long = F.filter(words(docstring), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*STOPWORDS))
    wanted = F.array_distinct(F.transform(long, lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION))))

    def share(x: Column) -> Column:
        return F.when(F.size(x["wanted"]) == 0, 1.0).otherwise(F.size(F.filter(x["wanted"], lambda w: F.contains(x["low"], w))) / F.size(x["wanted"]))

    return let(F.struct(wanted.alias("wanted"), F.lower(spec).alias("low")), share)


def docstring_of(prompt: Column) -> Column:
    return F.when(prompt.rlike(DOCSTRING), strip(F.regexp_extract(prompt, DOCSTRING, 1))).otherwise(prompt)


def sbc(reference: Column, hypothesis: Column) -> Column:
    """The mean of bigram precision (the semantic score), unigram precision and completeness."""
    return (bigram_precision(reference, hypothesis) + unigram_precision(reference, hypothesis) + completeness(reference, hypothesis)) / 3.0


def messages(system: str, user: Column) -> Column:
    """A chat request: system and user messages."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def fenced_code(raw: Column) -> Column:
    """A reply's code: what its leading fence holds, else all of it, stripped."""
    text = strip(raw)
    leading = r"(?s)^```(?:python)?\s*(.*?)```"
    return F.when(text.rlike(leading), strip(F.regexp_extract(text, leading, 1))).otherwise(text)
