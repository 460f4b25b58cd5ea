"""Identifiers in text as column expressions (N1-N12): digit runs, cards, ids, phones, IBANs, IP addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sottovoce.functions.text import DOT, bound

# Words that stand for digits, by language.
DIGIT_WORDS = {
    # English
    "zero": "0", "oh": "0", "o": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    # Urdu and Hindi in Latin letters
    "sifar": "0", "sifr": "0", "ek": "1", "do": "2", "teen": "3", "tin": "3", "char": "4", "chaar": "4", "panch": "5", "paanch": "5", "chhe": "6",
    "chay": "6", "che": "6", "chhah": "6", "saat": "7", "sat": "7", "aath": "8", "aat": "8", "nau": "9", "no": "9",
    # Urdu
    "صفر": "0", "ایک": "1", "دو": "2", "تین": "3", "چار": "4", "پانچ": "5", "چھ": "6", "چھے": "6", "سات": "7", "آٹھ": "8", "نو": "9",
    # Hindi
    "शून्य": "0", "एक": "1", "दो": "2", "तीन": "3", "चार": "4", "पांच": "5", "छह": "6", "छः": "6", "सात": "7", "आठ": "8", "नौ": "9",
    # Arabic
    "واحد": "1", "اثنان": "2", "ثلاثہ": "3", "اربعہ": "4", "خمسہ": "5", "ستہ": "6", "سبعہ": "7", "ثمانیہ": "8", "تسعہ": "9",
}
# Words that repeat the next digit, that may stand between digits, that stand for a dot, and digit words that are common otherwise.
REPEATERS = {"double": 2, "triple": 3, "ڈبل": 2, "ٹرپل": 3, "डबल": 2, "ट्रिपल": 3}
JOINERS = ["dash", "hyphen", "space", "and"]
DOT_WORDS = ["dot", "point", "ڈاٹ", "डॉट"]
AMBIGUOUS = ["do", "no", "oh", "o", "sat", "che", "tin", "دو", "نو", "दो"]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"
IBAN = r"\b[a-z]{2}\d{2}(?:\s?[a-z0-9]{4}){2,7}(?:\s?[a-z0-9]{1,4})?\b"
#: What stands in each of them and begins with what is rare; word boundaries are only asked for in texts that have it.
IPV4_PART = r"\.\d{1,3}\.\d{1,3}\.\d"
IBAN_PART = r"[a-z]{2}\d{2}\s?[a-z0-9]{4}\s?[a-z0-9]{4}"
MIN_RUN = 7
#: Letters of four digits with three of the shortest dot words and spaces between them.
MIN_QUAD = 4 + 3 * min(map(len, DOT_WORDS)) + 6


def any_word(values: list[str]) -> str:
    """A pattern of any of the words, by their letters in turn, so that a word that is none of them is left after a letter or two.
    Where a space or the end must follow, at most one of them fits. The empty word among them fits anywhere."""
    after: dict[str, list[str]] = {}
    for w in sorted({v for v in values if v}):
        after.setdefault(w[0], []).append(w[1:])
    some = [c + any_word(rest) for c, rest in after.items()]
    found = some[0] if len(some) == 1 else f"(?:{'|'.join(some)})" if some else ""
    return f"(?:{found})?" if "" in values and found else found


def _may() -> dict[str, str]:
    """Patterns, for one automaton, of what each text in normal form has that digit_words(), written_ipv4() or account_shapes() find
    something in; other texts may have it, too. In normal form dots are gaps, and so are line ends."""
    digit, repeat, join, dot = (any_word(list(words)) for words in (DIGIT_WORDS, REPEATERS, JOINERS, DOT_WORDS))
    # seven digits, be they written together, or what repeats a digit; or four numbers, between which dots may be spoken
    unit, between = f"(?:[0-9] ?|{digit}(?: |$))", f"(?:(?:{join}|{repeat}) )*"
    run = f"(?:^| )(?:(?:{between}{unit}){{{MIN_RUN}}}|{between}{repeat} {between}{unit})"
    quad = f"(?:^| )(?:(?:[0-9]+|{digit})(?: |$)(?:{dot} )*){{4}}"
    return {"digits": f"{run}|{quad}", "written": r"\p{Nd} \p{Nd}{1,3} \p{Nd}{1,3} \p{Nd}", "accounts": r"[a-z]{2}\p{Nd}{2} ?[a-z0-9]{4} ?[a-z0-9]{4}"}


#: What a text may hold: name -> pattern.
MAY = _may()


def _stretches(normal: Column, words: list[str]) -> Column:
    """The longest stretches of digits and of the words given. Each is found by the space before it, as other places are passed over
    fastest by a letter, and the text is given one in front."""
    return F.regexp_extract_all(F.concat(F.lit(" "), normal), F.lit(rf" (?:(?:[0-9]++|{any_word(words)})(?: |$))++"), F.lit(0))


def digit_words(normal: Column) -> Column:
    """What digit_runs() of MIN_RUN digits and spoken_ipv4() are looked for in, of a text in normal form: its stretches of their words
    that are long enough for one of them, with a word between that is none of theirs."""
    long_ = F.filter(_stretches(normal, [*DIGIT_WORDS, *REPEATERS, *JOINERS, *DOT_WORDS]), lambda s: F.length(F.trim(s)) >= MIN_RUN)
    return F.array_join(F.transform(long_, lambda s: F.trim(s)), " | ")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def digit_runs(normal: Column, least: int = 3) -> Column:
    """Runs of spoken or written digits (N1-N3) of a text in normal form, of three digits, or `least`, at least.

    A pattern finds the stretches of digit words; only those are folded, token by token. What stands between
    stretches closes a run, so folding each alone gives the same runs."""
    digits, repeats = _map(DIGIT_WORDS), _map(REPEATERS)
    empty = F.struct(F.array().cast("array<string>").alias("runs"), F.lit("").alias("cur"), F.lit(1).alias("rep"), F.lit(False).alias("sure"))

    def closed(acc: Column) -> Column:
        return F.when(acc["sure"] & (F.length(acc["cur"]) >= least), F.array_append(acc["runs"], acc["cur"])).otherwise(acc["runs"])

    def step(acc: Column, tok: Column) -> Column:
        plain = tok.rlike("^[0-9]+$")
        digit = F.when(plain, tok).otherwise(F.element_at(digits, tok))
        times = F.when(plain & (F.length(tok) > 1), 1).otherwise(acc["rep"])
        return (
            F.when(digit.isNotNull(), F.struct(acc["runs"].alias("runs"), F.concat(acc["cur"], F.repeat(digit, times)).alias("cur"), F.lit(1).alias("rep"), (acc["sure"] | ~tok.isin(AMBIGUOUS)).alias("sure")))
            .when(F.element_at(repeats, tok).isNotNull(), F.struct(acc["runs"].alias("runs"), acc["cur"].alias("cur"), F.element_at(repeats, tok).alias("rep"), acc["sure"].alias("sure")))
            .when(tok.isin(JOINERS) & (acc["cur"] != ""), acc)
            .otherwise(F.struct(closed(acc).alias("runs"), F.lit("").alias("cur"), F.lit(1).alias("rep"), F.lit(False).alias("sure")))
        )

    # no word is shorter than its digits, so short stretches hold no run
    stretches = F.filter(_stretches(normal, [*DIGIT_WORDS, *REPEATERS, *JOINERS]), lambda s: F.length(s) >= least)
    return F.flatten(F.transform(stretches, lambda s: F.aggregate(F.split(F.trim(s), " "), empty, step, closed)))


def _where(folded: Column, pattern: str, part: str) -> Column:
    """All that a pattern finds in texts that have a part of it; none elsewhere."""
    all_of = lambda t: F.when(~t.rlike(f"(?U){part}"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(t, F.lit(f"(?U){pattern}"), F.lit(0)))
    return bound(folded, all_of)


def written_ipv4(folded: Column) -> Column:
    """Dotted quads of casefolded text."""
    return _where(folded, IPV4, IPV4_PART)


def spoken_ipv4(normal: Column) -> Column:
    """Quads with spoken dots (N5) of a text in normal form."""
    digits = _map(DIGIT_WORDS)
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"))

    def step(acc: Column, tok: Column) -> Column:
        digit = F.when(tok.rlike("^[0-9]+$"), tok).otherwise(F.element_at(digits, tok))
        ended = F.when(acc["cur"] != "", F.array_append(acc["parts"], acc["cur"])).otherwise(acc["parts"])
        more = F.struct(acc["parts"].alias("parts"), F.concat(acc["cur"], digit).alias("cur"))
        # a dot word after another dot word ends the address, which the marker "." keeps
        dot = F.when(acc["cur"] != "", ended).otherwise(F.array_append(ended, F.lit(".")))
        return F.when(digit.isNotNull(), more).otherwise(F.struct(dot.alias("parts"), F.lit("").alias("cur")))

    def done(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.array_append(acc["parts"], acc["cur"])).otherwise(acc["parts"])

    stretches = F.filter(_stretches(normal, [*DIGIT_WORDS, *DOT_WORDS]), lambda s: F.length(s) >= MIN_QUAD)
    parts = F.transform(stretches, lambda s: F.split(F.array_join(F.aggregate(F.split(F.trim(s), " "), empty, step, done), ";"), r";?\.;?"))
    quads = F.transform(F.flatten(parts), lambda q: F.split(q, ";"))
    good = F.filter(quads, lambda q: (F.size(q) == 4) & F.forall(q, lambda o: o.rlike(r"^0*[0-9]{1,3}$") & (o.cast("bigint") <= 255)))
    return F.transform(good, lambda q: F.array_join(q, "."))


def account_shapes(folded: Column) -> Column:
    """Where IBANs may stand in casefolded text, as it stands there."""
    return _where(folded, IBAN, IBAN_PART)


def ibans(folded: Column, shapes: Column | None = None) -> Column:
    """IBAN-shaped values (N6) of casefolded text, without spaces; there is no check of their digits' sum. shapes: account_shapes(), if known."""
    found = F.transform(account_shapes(folded) if shapes is None else shapes, lambda v: F.replace(v, F.lit(" "), F.lit("")))
    return F.filter(found, lambda v: F.length(v).between(15, 34) & (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 10))


def residual(folded: Column) -> Column:
    """What digit runs are looked for in (N7): without addresses and IBANs, a dot is a word."""
    return F.replace(F.regexp_replace(F.regexp_replace(folded, f"(?U){IPV4}", " "), f"(?U){IBAN}", " "), F.lit("."), F.lit(" dot "))


def luhn(digits: Column) -> Column:
    """The modulo-10 check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0, F.lit(False))


def classify(digits: Column, cnic: bool = True) -> Column:
    """The kind of a run of digits (N9); null for none."""
    n = F.length(digits)
    first = F.when(n < MIN_RUN, None)
    if cnic:
        first = first.when(n == 13, "cnic")
    return (
        first.when(n.between(13, 19) & luhn(digits), "payment_card")
        .when(((n == 11) & digits.startswith("03")) | ((n == 12) & digits.startswith("923")), "phone")
        .when(n >= 9, "long_number")
        .when(digits.startswith("0"), "phone")
    )


def mask(value: Column) -> Column:
    """N10."""
    n = F.length(value)
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(3)), F.repeat(F.lit("*"), n - 6), F.right(value, F.lit(3))))


def _is(kind: str, cnic: bool):
    return lambda run: classify(run, cnic) == kind


MATCH = "category:string,phrase:string,weight:double,lang:string,match:string,similarity:double,pattern:string,windows:int"


def dotted(folded: Column, normalise_marks) -> Column:
    """Casefolded text in normal form but for its dots, which are words of their own, each DOT. normalise_marks: T3-T7 on a column."""
    return normalise_marks(F.replace(folded, F.lit("."), F.lit(f" {DOT} ")))


def undotted(folded: Column, marked: Column, normalise_marks) -> Column:
    """The normal form of casefolded text, from dotted() of it."""
    without = F.trim(F.replace(F.concat(marked, F.lit(" ")), F.lit(f"{DOT} "), F.lit("")))
    return F.when(F.contains(folded, F.lit(DOT)), normalise_marks(folded)).otherwise(without)


def spelled(folded: Column, marked: Column, normalise_marks) -> Column:
    """The normal form of casefolded text in which a dot is a word, from dotted() of it."""
    return F.when(F.contains(folded, F.lit(DOT)), normalise_marks(F.replace(folded, F.lit("."), F.lit(" dot ")))).otherwise(F.replace(marked, F.lit(DOT), F.lit("dot")))


def long_runs_in(folded: Column, spelt: Column, written: Column, accounts: Column, normalise_marks) -> Column:
    """long_runs() of text whose spelled() form, written_ipv4() and account_shapes() are known: without the last two, what digit runs are looked for in is the first."""
    plain = (F.size(written) == 0) & (F.size(accounts) == 0)
    return digit_runs(F.when(plain, spelt).otherwise(normalise_marks(residual(folded))), MIN_RUN)


def long_runs(folded: Column, normalise_marks) -> Column:
    """The digit runs of casefolded text that are long enough to classify. normalise_marks: T3-T7 on a column."""
    return digit_runs(normalise_marks(residual(folded)), MIN_RUN)


def quads(folded: Column, normalise_marks) -> Column:
    """Written and spoken addresses of casefolded text."""
    return F.array_union(written_ipv4(folded), spoken_ipv4(normalise_marks(F.replace(folded, F.lit("."), F.lit(" dot ")))))


def scan(folded: Column, runs: Column, addresses: Column, rules: dict[str, tuple[float, str]], accounts: Column | None = None) -> Column:
    """Pattern hits (N11, N12) of casefolded text as an array of matches, heaviest first, without repeats.

    runs, addresses: columns of long_runs() and quads(), which are worth a column of their own as they are used more than
    once. accounts: account_shapes(), if known. rules: kind -> (weight, label); a kind without a rule is not looked for."""

    def hits(kind: str, values: Column, shown) -> Column:
        weight, label = rules[kind]
        return F.transform(F.array_distinct(values), lambda v: F.struct(
            F.lit("sensitive_pattern").alias("category"), F.concat(F.lit(f"{label}: "), shown(v)).alias("phrase"), F.lit(float(weight)).alias("weight"), F.lit("any").alias("lang"),
            F.lit(None).cast("string").alias("match"), F.lit(None).cast("double").alias("similarity"), F.lit(kind).alias("pattern"), F.lit(None).cast("int").alias("windows")))

    parts = []
    if "ipv4" in rules:
        parts.append(hits("ipv4", addresses, lambda v: F.concat(F.regexp_extract(v, r"^(.*)\.[^.]*$", 1), F.lit(".*"))))
    if "iban" in rules:
        parts.append(hits("iban", ibans(folded, accounts), lambda v: mask(F.upper(v))))
    for kind in ("cnic", "payment_card", "phone", "long_number"):
        if kind in rules:
            parts.append(hits(kind, F.filter(runs, _is(kind, "cnic" in rules)), mask))
    if not parts:
        return F.array().cast(f"array<struct<{MATCH}>>")
    return F.array_sort(F.concat(*parts), lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).otherwise(0))
