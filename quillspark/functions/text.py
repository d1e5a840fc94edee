"""Text functions as Catalyst expressions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.unicode import nfkc as normal_form
from . import constants as K


def sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def nfkc(text: Column) -> Column:
    """The NFKC form. Only texts with a character that it may change go through Python; for the others that side is null."""
    return F.coalesce(normal_form(F.when(text.rlike(f"[\\x80-\\x{{10ffff}}&&[^{K.NFKC_STABLE}]]"), text)), text)


def tokens(text: Column) -> Column:
    """Of the lower-cased NFKC form: bigrams of CJK runs, then Latin words with inner marks; null gives none."""
    low = F.lower(nfkc(F.coalesce(text, F.lit(""))))
    words = lambda x: F.regexp_extract_all(x, F.lit(K.WORD), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"{K.CJK}+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))))
    return F.when(low.rlike(K.CJK), F.concat(pairs, words(F.regexp_replace(low, K.CJK, " ")))).otherwise(words(low))


def collapsed(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_noise(line: Column) -> Column:
    marks = F.array(*(F.lit(m) for m in K.CITATION_MARKS))
    return line.rlike("(?i)" + "|".join(f"(?:{p})" for p in K.NOISE_LINES)) | (F.size(F.filter(marks, lambda m: F.contains(F.lower(line), m))) >= 2)


def clean(text: Column) -> Column:
    """Lines with inner white space collapsed, furniture dropped, and at most one blank line between."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[^\S\n]+", " ")))
    kept = F.array_join(F.filter(lines, lambda x: (x == "") | ~is_noise(x)), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def is_page_mark(line: Column) -> Column:
    """A running header: "page N (of M)", or digits and decoration with a digit."""
    return line.rlike(r"(?i)^page\s+\d+(\s+of\s+\d+)?$") | line.rlike(r"^(?=.*\d)[\d\s\-–—.·|/()\[\]]+$")


def pdf_clean(text: Column) -> Column:
    joined = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    lines = F.transform(F.split(joined, "\n"), collapsed)
    kept = F.array_join(F.filter(lines, lambda x: ~is_page_mark(x)), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def transcript_clean(text: Column) -> Column:
    return collapsed(F.regexp_replace(F.regexp_replace(text, r"\[.*?\]", ""), r"\(.*?\)", ""))


def speech(markdown: Column) -> Column:
    """Markdown as it would be read aloud, line by line: without fenced code, marks, rules and addresses, with the labels of links and images."""

    def spoken(line: Column) -> Column:
        line = F.regexp_replace(line, K.LINE_MARKS, "")
        for pattern in (K.EMPHASIS, K.EMPHASIS):  # outer marks, then inner ones
            line = F.regexp_replace(line, pattern, "$1$2$3$4")
        line = F.regexp_replace(F.regexp_replace(line, K.RULE, ""), K.UNSPOKEN, " ")
        return F.trim(F.regexp_replace(line, "[ \t]+", " "))

    plain = F.regexp_replace(F.regexp_replace(markdown, K.FENCE, " "), K.CODE, "$1")
    lines = F.split(F.regexp_replace(plain, K.LABELLED, "$1"), "\n")
    return F.array_join(F.filter(F.transform(lines, spoken), lambda x: x != ""), "\n")


def shortened(text: Column, most: int = K.BULLET_CHARS) -> Column:
    """At most so many characters: cut at the last space of them, without marks at the end; uncut if nothing else is left."""
    flat = collapsed(text)
    head = F.substr(flat, F.lit(1), F.lit(most))
    cut = F.regexp_replace(F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"^(.*) ", 1)).otherwise(head), "[ ,;:-]+$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit("…")))


def leading_sentences(text: Column, most: int = K.BULLETS) -> Column:
    """The first whole sentences of at least three words, shortened."""
    found = F.filter(F.split(collapsed(text), r"(?<=[.!?])\s+"), lambda s: s.rlike("[.!?]$") & (F.size(F.split(s, " ")) >= K.LEAST_WORDS))
    return F.transform(F.slice(found, 1, most), lambda s: shortened(s))


def sentences(text: Column) -> Column:
    """CJK terminators end a sentence with the closing marks after them; Latin ones before white space only, abbreviations and single capitals aside."""
    guarded = F.regexp_replace(text, rf"(?U)\b({'|'.join(K.ABBREVIATIONS)})\.|\b([A-Z])\.", "$1$2\x01")
    closing = "".join("\\" + c if c in "]\"'" else c for c in K.CLOSING_MARKS)
    marked = F.regexp_replace(guarded, rf"(?U)([{K.CJK_TERMINATORS}]+[{closing}]*|[{K.LATIN_TERMINATORS}](?=\s|$))", "$1\x02")
    parts = F.transform(F.split(marked, "\x02"), lambda s: F.regexp_replace(F.translate(s, "\x01", "."), r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def prompt_tokens(text: Column) -> Column:
    """CJK characters, and a quarter of all others, rounded down."""
    text = F.coalesce(text, F.lit(""))
    wide = F.regexp_count(text, F.lit(K.CJK_CHARGED))
    return (wide + F.floor((F.length(text) - wide) / 4)).cast("long")


def extract_answer(prompt: Column) -> Column:
    """The answer without a model: the first three pieces of what stands between the first "Context:" and the first "Question:", announced if it cites a source."""
    context = F.trim(F.regexp_extract(prompt, r"(?s)Context:(.*?)Question:", 1))
    answer = F.concat(F.array_join(F.slice(F.split(context, r"\. "), 1, 3), ". "), F.lit("."))
    announced = F.when(F.contains(answer, F.lit("[Source")), F.concat(F.lit(K.ANSWER_HEAD), answer, F.lit(K.ANSWER_NOTE))).otherwise(answer)
    return F.when(F.contains(prompt, F.lit("Context:")) & F.contains(prompt, F.lit("Question:")), announced).otherwise(F.lit(K.NO_ANSWER))


def output_budget(asked: Column, most: Column, floor: Column, ceiling: Column, prompt: Column) -> Column:
    """Output tokens of a call: what it asks for (null: the model's most), no less than the floor, and no more than a ceiling (null: none) leaves beside the prompt; null where that is no more than the floor."""
    budget = F.greatest(F.coalesce(asked, most), floor, F.lit(1))
    room = ceiling - prompt
    return F.when(ceiling.isNull(), budget).when(room > floor, F.least(budget, room)).cast("long")


def token_ceiling(message: Column) -> Column:
    """The limit that a provider's refusal names, if it counts tokens and not requests; else null."""
    low = F.lower(message)
    has = lambda marks: low.rlike("|".join(m.replace("(", r"\(").replace(")", r"\)") for m in marks))
    limit = F.nullif(F.regexp_extract(message, K.TOKEN_LIMIT, 1), F.lit("")).cast("long")
    return F.when(has(K.TOKEN_MARKS) & ~has(K.REQUEST_MARKS) & (limit > 0), limit)


def video_id(url: Column) -> Column:
    """Id of a video address in its usual forms, else null."""
    found = [F.regexp_extract(url, p, 1) for p in (r"(?:v=|/)([0-9A-Za-z_-]{11})(?:[?&/#]|$)", r"youtu\.be/([0-9A-Za-z_-]{11})")]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found), F.nullif(F.regexp_extract(url, r"[?&]v=([^&#]+)", 1), F.lit("")))


def cache_key(question: Column, scope: Column, *settings: Column) -> Column:
    """SHA-256 of the question, the sorted scope (none: any) and the settings, a null one as None."""
    named = [F.coalesce(x.cast("string"), F.lit("None")) for x in settings]
    return F.sha2(F.concat_ws("|", question, named[0], F.coalesce(F.array_join(F.array_sort(scope), ","), F.lit("any")), *named[1:]), 256)


def squashed(text: Column) -> Column:
    """NFKC and lower case, without any white space."""
    return F.lower(F.regexp_replace(nfkc(text), r"(?U)\s+", ""))


def clock(seconds: Column) -> Column:
    """m:ss."""
    whole = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def phrase(labels: Column) -> Column:
    """"a, b and c" of an array of labels, without full stops at their ends; blank ones are left out."""
    spoken = F.filter(F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.regexp_replace(x, r"\.+$", "")), lambda x: x.isNotNull())
    n = F.size(spoken)
    several = F.concat(F.array_join(F.slice(spoken, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(spoken, n - 1))
    return F.when(n == 0, "").when(n == 1, F.get(spoken, F.lit(0))).otherwise(several)


def first_object(reply: Column) -> Column:
    """The JSON object of a reply, as text: all of it, or what stands from its first { to its last }; null if neither is an object."""
    candidates = [F.trim(reply), F.regexp_extract(reply, r"(?s)(\{.*\})", 1)]
    is_object = lambda x: F.when(x.rlike(r"(?s)^\s*\{") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(*(is_object(x) for x in candidates))
