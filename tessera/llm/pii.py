"""Format-preserving pseudonyms for personal data, by keyed Feistel networks, in built-in Spark expressions alone.

Numbers and dates that pass their validation (Luhn for cards, ISO 7064 for IBANs, ranges for addresses, phone and
social security numbers, the calendar for dates), mail names and quoted secrets are replaced by values of the same
form that pass the same validation. A replacement depends on the key, the kind and the value only, so equal values
stay linked across documents, and whoever has the key can undo it (`reveal`).

Each kind is a permutation of its own domain:

* digits and letters (cards, phones, IBANs, mail names, secrets): the string is cut in two halves; in each round every
  character of one half moves within its class (digits, small letters, capitals) by a keyed hash of the other half,
  the round and its place. Check digits are computed anew.
* IP addresses: two 16-bit halves. Dates: days of a 400-year cycle (1800 to 2199) as 189 x 773; slashed dates are read
  month first, and where that is no date day first, which permutes the cycle's days after the 12th as 9 x 9833. Social security
  numbers: 898 areas x 989,901 groups and serials. Each round adds a keyed hash of one part to the other.

A key is a constant of the plan: where plans are shown or logged, `spark.sql.redaction.string.regex` has to cover it.

Defined results: a null text stays null, an empty one empty. A text without personal data is returned as it is.
Candidates that fail validation stay as they are. Dates outside 1800 to 2199 stay. Very long texts are searched whole,
and secrets may have any length. Repeated rows are treated alike;
an empty table gives an empty result; other columns pass through. Findings overlap never: the leftmost candidate
goes first, in the order of `KINDS` at one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, quoted, table

ROUNDS = 8
#: The setting of the session that holds the key of the registered query and the pipeline, and the key where it is unset.
KEY_SETTING, DEMO_KEY = "spark.tessera.pii.key", "a key for demonstrations only"

# The length of an IBAN by country, as the registry has it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_form() -> str:
    """IBANs as long as their country's; if none fits, of any length, so that no word after one is taken for its end."""
    groups = lambda n: f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}{groups(n - 4)}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?:{known}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"


# The form of each kind, in the order in which they are tried.
KINDS = {
    "secret": r"(?i:(?<![a-z])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"'][a-z0-9_+/=-]{12,}+[\"'])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": _iban_form(),
    "ip": r"(?<![\w.])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])|(?<![\w./])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\w/])|(?<![\w./])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![\w/])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![\w])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\w-])|(?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w])",
}
ANY = "|".join(f"(?:{x})" for x in KINDS.values())
#: No kind is without one of these.
HINT = r"[0-9@]|[=:][ \t]{0,4}[\"']"


def _let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, however often it is read, and within lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash(key: Column, *parts: Column) -> Column:
    """60 bits of a keyed SHA-256."""
    joined = F.concat_ws("|", key, *(p.cast("string") for p in parts), key)
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("bigint")


def _rounds(rounds: int, back: bool) -> Column:
    return F.array(*(F.lit(r) for r in (reversed(range(rounds)) if back else range(rounds))))


def _shifted(part: Column, other: Column, key: Column, kind: str, r: Column, hexadecimal: Column, sign: int) -> Column:
    def one(seed: Column, c: Column, i: Column) -> Column:
        a, h = F.ascii(c), _hash(seed, i) * sign
        letters = F.when(hexadecimal, 6).otherwise(26)
        moved = lambda base, size: F.chr(base + F.pmod(a - base + F.pmod(h, size), size))
        return F.when(c == "", c).when(a.between(48, 57), moved(F.lit(48), F.lit(10))).when(a.between(97, 122), moved(F.lit(97), letters)).when(a.between(65, 90), moved(F.lit(65), letters)).otherwise(c)

    # The other half is hashed once a round, so that a long value costs no square.
    seed = F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), other, key), 256)
    return _let(seed, lambda x: F.array_join(F.transform(F.split(part, ""), lambda c, i: one(x, c, i)), ""))


def permute_text(value: Column, key: Column, kind: str, back: bool = False, rounds: int = ROUNDS) -> Column:
    """`value` with its digits and ASCII letters permuted within their classes; undone by `back`."""
    half = (F.length(value) / 2).cast("int")
    hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")

    def step(acc: Column, r: Column) -> Column:
        left, right = F.substring(acc, F.lit(1), half), F.substring(acc, half + 1, F.length(acc))
        sign = -1 if back else 1
        return F.when(r % 2 == 0, F.concat(_shifted(left, right, key, kind, r, hexadecimal, sign), right)).otherwise(F.concat(left, _shifted(right, left, key, kind, r, hexadecimal, sign)))

    return F.aggregate(_rounds(rounds, back), value, step)


def permute_pair(a: Column, size_a: int, b: Column, size_b: int, key: Column, kind: str, back: bool = False, rounds: int = ROUNDS) -> Column:
    """A struct of `a` in 0..size_a-1 and `b` in 0..size_b-1, permuted together."""
    sign = -1 if back else 1

    def step(acc: Column, r: Column) -> Column:
        x, y = acc["a"], acc["b"]
        moved = lambda v, other, size: F.pmod(v + F.pmod(_hash(key, F.lit(kind), r, other) * sign, F.lit(size)), F.lit(size)).cast("bigint")
        return F.when(r % 2 == 0, F.struct(moved(x, y, size_a).alias("a"), y.alias("b"))).otherwise(F.struct(x.alias("a"), moved(y, x, size_b).alias("b")))

    return F.aggregate(_rounds(rounds, back), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, symbols: Column, pattern: str = "[0-9]") -> Column:
    """`value` with its characters of the class `pattern` replaced, in order, by `symbols`."""
    def one(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), pattern.replace("[", "[^", 1), ""))
        return F.when(c.rlike(pattern), F.substring(symbols, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last stands in an even place, that is, of all but the check digit."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)).otherwise(0)


def _body(digits: Column) -> Column:
    return F.substring(digits, F.lit(1), F.length(digits) - 1)


def luhn_valid(digits: Column) -> Column:
    return (luhn_sum(_body(digits)) + F.substring(digits, -1, 1).cast("int")) % 10 == 0


def _card(v: Column, key: Column, back: bool) -> Column:
    with_check = lambda body: F.concat(body, F.pmod(-luhn_sum(body), F.lit(10)).cast("string"))
    moved = lambda digits: _let(_let(permute_text(_body(digits), key, "card", back), with_check), lambda new: _laid_out(v, new))
    return _let(_digits(v), lambda digits: F.when(luhn_valid(digits), moved(digits)).otherwise(v))


def _modulo_97(compact: Column) -> Column:
    """Of an IBAN without spaces: country and check digits last, letters as numbers from 10."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    step = lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _iban(v: Column, key: Column, back: bool) -> Column:
    country = F.substring(v, 1, 2)

    def with_check(moved: Column) -> Column:
        check = F.lpad((F.lit(98) - _modulo_97(F.concat(country, F.lit("00"), moved))).cast("string"), 2, "0")
        return F.concat(country, check, moved)

    def one(compact: Column) -> Column:
        moved = permute_text(F.substring(compact, F.lit(5), F.length(compact)), key, "iban", back)
        laid_out = _let(_let(moved, with_check), lambda new: _laid_out(v, new, "[A-Z0-9]"))
        return F.when((F.length(compact) >= 15) & (_modulo_97(compact) == 1), laid_out).otherwise(v)

    return _let(F.replace(v, F.lit(" "), F.lit("")), one)


def _phone(v: Column, key: Column, back: bool) -> Column:
    # The country code stays: what stands between a plus and the next character that is no digit, if that is short.
    code = F.when(v.rlike(r"^\+[0-9]{1,3}[^0-9]"), F.regexp_extract(v, r"^\+[0-9]{1,3}", 0)).otherwise(F.regexp_extract(v, r"^\+?", 0))
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    n = F.length(_digits(v))
    return F.when(n.between(8, 15), F.concat(code, _let(permute_text(_digits(rest), key, "phone", back), lambda new: _laid_out(rest, new)))).otherwise(v)


def _email(v: Column, key: Column, back: bool) -> Column:
    name = F.substring_index(v, "@", 1)
    return F.concat(permute_text(name, key, "email", back), F.substring(v, F.length(name) + 1, F.length(v)))


def _secret(v: Column, key: Column, back: bool) -> Column:
    head = F.regexp_extract(v, r"^.*?[=:][ \t]*[\"']", 0)
    value = F.substring(v, F.length(head) + 1, F.length(v) - F.length(head) - 1)
    return F.concat(head, permute_text(value, key, "secret", back), F.substring(v, -1, 1))


def _ip(v: Column, key: Column, back: bool) -> Column:
    o = F.transform(F.split(v, "\\."), lambda x: x.cast("int"))
    p = permute_pair(F.get(o, 0) * 256 + F.get(o, 1), 65_536, F.get(o, 2) * 256 + F.get(o, 3), 65_536, key, "ip", back)
    return _let(p, lambda x: F.concat_ws(".", F.shiftright(x["a"], 8).cast("string"), (x["a"] % 256).cast("string"), F.shiftright(x["b"], 8).cast("string"), (x["b"] % 256).cast("string")))


def _late_day(v: Column, first: Column, key: Column, back: bool) -> Column:
    """A slashed date that can only be read day first, as another: days from the 13th on, 9 x 9833 in the cycle."""
    day = F.to_date(F.try_to_timestamp(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)), F.lit("yyyy-MM-dd")))
    # Twelve days of each month before, and of this one, are left out of the count.
    start = lambda month: F.datediff(F.add_months(first, month), first) - 12 * month

    def written(n: Column) -> Column:
        near = F.floor(n * 4800 / 88_497).cast("int")
        month = F.element_at(F.filter(F.sequence(near - 3, near + 3), lambda m: start(m) <= n), -1)
        return _let(month, lambda m: F.date_format(F.date_add(F.add_months(first, m), (n - start(m) + 12).cast("int")), "dd/MM/yyyy"))

    def moved(n: Column) -> Column:
        p = permute_pair((n / 9833).cast("int"), 9, n % 9833, 9833, key, "late day", back)
        return _let(_let(p, lambda x: x["a"] * 9833 + x["b"]), written)

    index = F.datediff(day, first) - 12 * ((F.year(day) - 1800) * 12 + F.month(day))
    return F.when((F.dayofmonth(day) > 12) & F.year(day).between(1800, 2199), _let(index, moved)).otherwise(v)


def _date(v: Column, key: Column, back: bool) -> Column:
    iso, slashed = v.rlike("^[0-9]{4}-"), v.rlike("/")
    at = lambda i, n: F.substring(v, i, n)
    written = F.when(iso, v).when(slashed, F.concat_ws("-", at(7, 4), at(1, 2), at(4, 2))).otherwise(F.concat_ws("-", at(7, 4), at(4, 2), at(1, 2)))
    first = F.expr("date'1800-01-01'")
    since = F.datediff(F.to_date(F.try_to_timestamp(written, F.lit("yyyy-MM-dd"))), first)

    def moved(days: Column) -> Column:
        p = permute_pair((days / 773).cast("int"), 189, days % 773, 773, key, "date", back)
        out = _let(_let(p, lambda x: F.date_add(first, (x["a"] * 773 + x["b"]).cast("int"))), lambda day: F.when(iso, F.date_format(day, "yyyy-MM-dd")).when(slashed, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy")))
        return F.when(days.between(0, 146_096), out).when(days.isNull() & slashed, _late_day(v, first, key, back)).otherwise(v)

    return _let(since, moved)


def _ssn(v: Column, key: Column, back: bool) -> Column:
    area, group, serial = F.substring(v, 1, 3).cast("int"), F.substring(v, 5, 2).cast("int"), F.substring(v, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = permute_pair(area - 1 - (area > 666).cast("int"), 898, (group - 1) * 9999 + serial - 1, 989_901, key, "ssn", back)
    written = _let(p, lambda x: F.concat_ws("-", F.lpad((x["a"] + 1 + (x["a"] >= 665).cast("int")).cast("string"), 3, "0"), F.lpad(((x["b"] / 9999).cast("int") + 1).cast("string"), 2, "0"), F.lpad((x["b"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(valid, written).otherwise(v)


_BY_KIND = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def replaced(found: Column, key: Column, back: bool = False) -> Column:
    """The pseudonym of a candidate, of the first kind whose form it has; itself if it fails validation."""
    out = F.when(F.lit(False), found)
    for kind, pattern in KINDS.items():
        out = out.when(found.rlike(f"^(?:{pattern})$"), _BY_KIND[kind](found, key, back))
    return out.otherwise(found)


def pseudonymised(df: DataFrame, key: str, text: str = "text", count: str | None = None, back: bool = False) -> DataFrame:
    """`df` with the personal data of `text` replaced and, if named, a column with the number of values replaced."""
    secret = F.lit(key)
    t = quoted(text)
    found, new = fresh("_found", df.columns), fresh("_new", [*df.columns, "_found"])
    candidates = F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    out = df.withColumn(found, candidates)
    between = F.split(t, ANY, -1)
    weave = lambda values: F.struct(
        F.array_join(F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(values, i), F.lit("")))), "").alias("text"),
        F.size(F.filter(F.zip_with(quoted(found), values, lambda a, b: a != b), lambda x: x)).cast("long").alias("n"),
    )
    changed = _let(F.transform(quoted(found), lambda v: replaced(v, secret, back)), weave)
    result = F.when(F.size(found) > 0, changed).otherwise(F.struct(t.alias("text"), F.lit(0).cast("long").alias("n")))
    kept = [c for c in df.columns if count is None or c.lower() != count.lower()]
    # A generator computes the result once and keeps later filters above it.
    out = out.select(*(quoted(c) for c in kept if c != text), F.explode(F.array(result)).alias(new))
    return out.select(*(quoted(new)["text"].alias(c) if c == text else quoted(c) for c in kept), *([quoted(new)["n"].alias(count)] if count else []))


def reveal(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Undoes `pseudonymised`."""
    return pseudonymised(df, key, text, back=True)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING) or DEMO_KEY


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark), count="n_replaced")
