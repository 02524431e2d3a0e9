"""Answers taken out of model output, and accuracy, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import WORD, strip


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(x)), lambda x: x != "")


def _last(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.element_at(items, -1))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)
    return F.when(got != "", got)


def _first_of(*found: Column) -> Column:
    return F.coalesce(*found, F.lit(""))


def letter_answer(text: Column) -> Column:
    """A to D, in this order: after 'Answer:', the last line that is one letter, after 'the answer is', a letter in
    front of a dot, bracket or space at the very beginning; else null."""
    alone = F.filter(_lines(text), lambda x: x.rlike("^[A-Da-d]$"))
    return F.upper(
        F.coalesce(
            _found(text, r"Answer:\s*([A-Da-d])"),
            _last(alone),
            _found(text, r"[Tt]he answer is\s*\(?([A-Da-d])"),
            _found(strip(text), r"^\(?([A-Da-d])\)?[.)\s]"),
        )
    )


def number_answer(text: Column) -> Column:
    """The number after '####', commas dropped, as a double."""
    return F.regexp_replace(_found(text, r"####\s*(-?[\d,]+\.?\d*)"), ",", "").try_cast("double")


def same_number(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) < 1e-6, F.lit(False))


def normalized_line(answer: Column) -> Column:
    """Without dots at the end, white space as single spaces, in lower case."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(strip(answer), r"\.+$", ""), r"\s+", " ")))


def line_answer(text: Column) -> Column:
    """What follows the first 'Answer:' in any case, up to the end of its line (of the next one, if it has nothing more),
    else the last line; normalised."""
    return normalized_line(_first_of(_found(text, r"(?i)Answer:\s*([^\n]+)"), _last(_lines(text))))


def _last_said(text: Column) -> Column:
    """What stands after the last 'Answer:' up to its line's end; null without one or with nothing there."""
    got = strip(_last(F.regexp_extract_all(strip(F.coalesce(text, F.lit(""))), F.lit(r"(?im)Answer:\s*([^\n]+)$"), 1)))
    return F.when(got != "", got)


#: Braces nested up to three deep.
_NESTED = r"(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*"
#: How answers in mathematics are rewritten before they are compared, in this order.
MATH_RULES = (
    (r"^`+|`+$", ""),
    (r"^\$+|\$+$", ""),
    (r"[.;,]+$", ""),
    (rf"^\\(?:boxed|fbox)\{{({_NESTED})\}}$", "$1"),
    (rf"^\\(?:boxed|fbox)\{{({_NESTED})\}}$", "$1"),
    (r"\\(?:boxed|fbox)\{([^{}]+)\}", "$1"),
    (r"\\(?:boxed|fbox)\{([^{}]+)\}", "$1"),
    (r"\\left|\\right|\\!|\\,", ""),
    (r"\\[td]frac", r"\\frac"),
    (r"\\cdot|\\times", "*"),
    ("[\u2212\u2013]", "-"),
    ("\\\\pi|\u03c0", "pi"),
    (r"\^\{?\\circ\}?", "deg"),
    (r"\\text\{([^{}]+)\}", "$1"),
    (r"\\mathrm\{([^{}]+)\}", "$1"),
    (r"\\operatorname\{([^{}]+)\}", "$1"),
    (r"\\sqrt\{([^{}]+)\}", "sqrt($1)"),
    (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "($1)/($2)"),
    (r"\{", "("),
    (r"\}", ")"),
    (r"\s+", ""),
)


def normalized_math(answer: Column) -> Column:
    a = strip(F.coalesce(answer, F.lit("")))
    for pattern, to in MATH_RULES:
        a = F.regexp_replace(a, pattern, to)
    return F.lower(a)


def math_answer(text: Column) -> Column:
    """The last 'Answer:', wherever it stands, else the last box without inner braces, else the last line; normalised."""
    box = strip(_last(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\\boxed\{([^{}]+)\}"), 1)))
    line = F.regexp_replace(_last(_lines(text)), "(?i)^(?:final answer|answer)\\s*[:\uff1a-]?\\s*", "")
    return normalized_math(_first_of(_last_said(text), box, line))


def _ratio(a: Column) -> tuple[Column, Column]:
    """Whole numbers, fractions of them and decimals without a rest, as numerator and denominator; else null."""
    part = lambda k: F.regexp_extract(a, r"^([-+]?\d+)(?:\.0+|/(\d+))?$", k)
    below = F.when(part(2) != "", part(2)).otherwise("1").try_cast("decimal(18,0)")
    return part(1).try_cast("decimal(18,0)"), F.nullif(below, F.lit(0))


def same_math(a: Column, b: Column) -> Column:
    """Equal after normalisation, or equal as whole numbers and fractions, or as decimals of 12 digits."""
    (n, d), (m, e) = _ratio(a), _ratio(b)
    digits = lambda x: F.when(x.rlike(r"^[-+]?\d+\.\d+$"), F.format_string("%.11e", x.try_cast("double")))
    return (a == b) | F.coalesce(n * e == m * d, F.lit(False)) | F.coalesce(digits(a) == digits(b), F.lit(False))


#: Kinds of graph tasks.
GRAPH_BINARY = ("bipartite", "connectivity", "cycle", "hamilton", "substructure")
GRAPH_NUMERIC = ("flow", "shortest", "triangle")
GRAPH_EXCLUDED = ("topology",)


def graph_answer(text: Column, task: Column) -> Column:
    """Of what follows the last 'Answer:', else the last '###', else of the last line: yes or no for tasks that ask for
    one (yes goes first), the first integer for those that ask for a number, otherwise all of it."""
    marked = strip(_last(F.regexp_extract_all(strip(F.coalesce(text, F.lit(""))), F.lit(r"(?m)###\s*([^\n]+)$"), 1)))
    got = F.regexp_replace(strip(_first_of(_last_said(text), F.when(marked != "", marked), _last(_lines(text)))), r"^\.+|\.+$", "")
    binary = F.when(F.lower(got).contains("yes"), F.lit("yes")).when(F.lower(got).contains("no"), F.lit("no"))
    return F.coalesce(F.when(task.isin(*GRAPH_BINARY), binary).when(task.isin(*GRAPH_NUMERIC), _found(got, r"(-?\d+)")), got)


def yes_no_label(text: Column, ascii_words: bool = False) -> Column:
    """Of what follows the last 'Answer:', else of the whole text: yes wherever the word stands, else no, else null.

    Letters of all scripts make up words, so 'ñno' isn't no.  With ``ascii_words`` only ASCII ones do, as in engines that
    use RE2; what a plain \\b means depends on the Java version.
    """
    said = _first_of(_last_said(text), text)
    t = F.lower(F.translate(said, "\u0130", "i") if ascii_words else said)  # Java's lower case of it is i and a mark
    word = "[0-9A-Za-z_]" if ascii_words else WORD
    alone = lambda w: t.rlike(f"(?<!{word}){w}(?!{word})")
    return F.when(alone("yes"), F.lit("yes")).when(alone("no"), F.lit("no"))


#: What a line of Python may begin with.
CODE_STARTS = ("def ", "class ", "import ", "from ", "return ", "#", "if ", "else:", "elif ", "for ", "while ", "try:", "except", "with ", "raise ")


def code_answer(text: Column) -> Column:
    """The first fenced block of Python (or of no language), else the text from the first blank or indented line, or line
    that begins like code, else the text.

    Nothing is run here: what the code is worth has to come in as a column.
    """
    t = strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(t, r"```(?:python)?\s*\n([\s\S]*?)```", 1)
    begins = F.regexp_extract(t, r"(?m)^(?:[ \t]|$|" + "|".join(CODE_STARTS) + r")[\s\S]*", 0)
    return F.when(t.rlike(r"```(?:python)?\s*\n[\s\S]*?```"), strip(fenced)).when(begins != "", begins).otherwise(t)


def _letters(said: Column, gold: Column, _: Column) -> tuple[Column, Column]:
    a = letter_answer(said)
    return a, a == F.upper(strip(gold))


def _numbers(said: Column, gold: Column, _: Column) -> tuple[Column, Column]:
    a = number_answer(said)
    return a.cast("string"), same_number(a, F.coalesce(number_answer(gold), F.regexp_replace(gold, ",", "").try_cast("double")))


def _line(said: Column, gold: Column, _: Column) -> tuple[Column, Column]:
    a = line_answer(said)
    return a, a == normalized_line(gold)


def _math(said: Column, gold: Column, _: Column) -> tuple[Column, Column]:
    a = math_answer(said)
    return a, same_math(a, normalized_math(gold))


def _graph(said: Column, gold: Column, kind: Column) -> tuple[Column, Column]:
    a = graph_answer(said, kind)
    return a, a == graph_answer(gold, kind)


def _yes_no(said: Column, gold: Column, _: Column) -> tuple[Column, Column]:
    a = yes_no_label(said)
    return a, a == yes_no_label(gold)


def _code(said: Column, passed: Column, _: Column) -> tuple[Column, Column]:
    return code_answer(said), passed.cast("boolean")


#: How a benchmark's answers are read and compared, by its names; mbpp takes whether the tests passed as its gold column.
SCORERS = {"gpqa": _letters, "mmlu": _letters, "gsm8k": _numbers, "bbh": _line, "mbpp": _code, "math500": _math, "graphwiz": _graph, "nlgraph_yesno": _yes_no}
#: Other names of benchmarks.
ALIASES = {"graph": "graphwiz", "graph_yesno": "nlgraph_yesno"}


def score(df: DataFrame, benchmark: str, said: str = "said", gold: str = "gold", kind: str | None = None) -> DataFrame:
    """``df`` with answer and correct by the benchmark's rules; no answer is wrong.  graphwiz leaves topology tasks out
    (``kind`` is the column of its tasks), nlgraph_yesno items without a label."""
    name = ALIASES.get(benchmark.lower(), benchmark.lower())
    if name not in SCORERS:
        raise KeyError(f"unknown benchmark {benchmark}")
    k = F.col(kind) if kind else F.lit(GRAPH_BINARY[0])
    if name == "graphwiz" and kind:
        df = df.where(~F.col(kind).isin(*GRAPH_EXCLUDED))
    if name == "nlgraph_yesno":
        df = df.where(yes_no_label(F.col(gold)).isNotNull())
    answer, correct = SCORERS[name](F.col(said), F.col(gold), k)
    return df.withColumn("answer", answer).withColumn("correct", F.coalesce(correct, F.lit(False)))


def summary(results: dict[str, DataFrame]) -> DataFrame:
    """A row per checkpoint: mean of its tasks' accuracies and how many there are, from tables of (task, accuracy)."""
    out = None
    for name, df in results.items():
        row = macro_average(df).withColumn("checkpoint", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def accuracy(df: DataFrame, correct: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("n_correct"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def macro_average(per_task: DataFrame, value: str = "accuracy") -> DataFrame:
    """Mean of the tasks' means, each task alike."""
    return per_task.agg(F.avg(value).alias("macro_average"), F.count("*").alias("n_tasks"))


def shards(df: DataFrame, index: str, n: int) -> DataFrame:
    """Item i belongs to shard i mod n."""
    return df.withColumn("shard", F.pmod(F.col(index), F.lit(n)).cast("int"))


def shuffled_options(question: Column, options: Column) -> Column:
    """Options in an order that the question fixes (by md5), so that every run has the same."""
    keyed = F.transform(options, lambda o: F.struct(F.md5(F.concat(question, F.lit(":"), o)).alias("key"), o.alias("option")))
    return F.transform(F.array_sort(keyed), lambda k: k["option"])
