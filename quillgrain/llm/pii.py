"""Format-preserving Feistel pseudonyms for personal data, in Spark SQL functions alone.

Found values are validated (octets of addresses, calendar dates, the check digits of IBANs and of
card numbers; what fails stays as it is) and then permuted inside their own
format by a keyed Feistel network. A date is found in a time stamp, too; the time of day stays.
An access key keeps the prefix that tells its kind, its separators and the case of its letters. The permutation depends on the key, the kind and the value
without its separators or case, so equal values stay linked across documents and spellings, and
different values stay different. Rounds run as an `aggregate` over the round numbers, with SHA-256
as round function.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1800-01-01 that dates are permuted among, as two digits of mixed radix.
DAYS = (365, 400)
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# Prefixes of access keys.
KEY_PREFIX = r"(?:sk_live_|sk_test_|pk_live_|sk-|ghp_|gho_|ghu_|ghs_|github_pat_|glpat-|hf_|AKIA|ASIA|AIza|xox[baprs]-)"
#: In order of precedence; the texts are looked through once, by their alternation.
PATTERNS = {
    # possessive throughout and only from the start of a run, so that no text makes it recurse or scan twice
    "email": r"(?<![\p{L}\p{N}._%+\-])[._%+\-]*+[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++(?<=\p{L}{2})",
    "secret": _EDGE + r"(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,128}" + _END,
    "apikey": _EDGE + KEY_PREFIX + r"(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-]{16,255}+" + _END,
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{2,4}\)?){2,4}" + _END,
    "ip": r"(?<![\p{L}\p{N}.])" + rf"(?:{_OCTET}\.)" + "{3}" + _OCTET + r"(?![\p{L}\p{N}]|\.[0-9])",
    "isodate": _EDGE + r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=T[0-9]{2}:[0-9]{2})|" + _END + ")",
    "daydate": _EDGE + r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}" + _END,
    "ssn": _EDGE + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _END,
    "phone10": r"(?<![\p{L}\p{N}])\(?[0-9]{3}\)?[ .\-][0-9]{3}[.\-][0-9]{4}" + _END,
    "number": _EDGE + r"(?:[0-9]{12,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _f(key: str, kind: str, i: Column, x: Column) -> Column:
    """Round function: 64 hex digits from the key, the kind, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256)


def _long(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 15), 16, 10).cast("long")


def permute_pair(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the pairs (0..a-1, 0..b-1): each round adds to one half, mod its size."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        to_left = i % 2 == 0
        return F.struct(
            F.when(to_left, F.pmod(s.l + F.pmod(_long(_f(key, kind, i, s.r)), a), a)).otherwise(s.l).alias("l"),
            F.when(to_left, s.r).otherwise(F.pmod(s.r + F.pmod(_long(_f(key, kind, i, s.l)), b), b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _bind(value: Column, f) -> Column:
    """f(value) with the value computed once, not at each of its mentions."""
    return F.element_at(F.transform(F.array(value), f), 1)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the strings of n digits, n from 2 to 18."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        pow10 = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
        pair = permute_pair(F.substr(d, F.lit(1), h), F.substr(d, h + 1), pow10(h), pow10(n - h), key, kind)
        pad = lambda x, k: F.lpad(x.cast("string"), k, F.lit("0"))
        return _bind(pair, lambda p: F.concat(pad(p.l, h), pad(p.r, n - h)))

    return _bind(digits, halves)


def _shift(x: Column, hexes: Column, alphabet: str) -> Column:
    """Each letter or digit moved on inside its class by a byte of the round function."""

    def one(c: Column, i: Column) -> Column:
        k = F.conv(F.substr(hexes, F.pmod(i * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
        if alphabet == "hex":
            return F.substr(F.lit("0123456789abcdef"), F.pmod(F.instr(F.lit("0123456789abcdef"), c) - 1 + k, F.lit(16)) + 1, F.lit(1))
        moved = lambda first, size: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + k, F.lit(size)))
        return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26)).otherwise(c)

    return F.when(x == "", x).otherwise(F.array_join(F.transform(F.split(x, ""), one), ""))


def permute_string(text: Column, key: str, kind: str, alphabet: str = "class") -> Column:
    """Keyed permutation of lower-case strings that keeps digits digits and letters letters."""

    def step(s: Column, i: Column) -> Column:
        to_left = i % 2 == 0
        return F.struct(
            F.when(to_left, _shift(s.l, _f(key, kind, i, s.r), alphabet)).otherwise(s.l).alias("l"),
            F.when(to_left, s.r).otherwise(_shift(s.r, _f(key, kind, i, s.l), alphabet)).alias("r"),
        )

    def run(t: Column) -> Column:
        h = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substr(t, F.lit(1), h).alias("l"), F.substr(t, h + 1).alias("r"))
        return _bind(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda p: F.concat(p.l, p.r))

    return _bind(text, run)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(form: Column, chars: Column, what: str) -> Column:
    """`form` with its characters of the class `what` replaced, in order, by `chars`."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("i"))

    def put(s: Column, c: Column) -> Column:
        hit = c.rlike(what)
        return F.struct(
            F.concat(s.o, F.when(hit, F.substr(chars, s.i, F.lit(1))).otherwise(c)).alias("o"), (s.i + hit.cast("int")).alias("i")
        )

    return F.aggregate(F.split(form, ""), start, put, lambda s: s.o)


def luhn(digits: Column) -> Column:
    """The Luhn check digit of a payload of digits."""
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    values = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: _bind(c.cast("int"), lambda v: F.when(i % 2 == 0, doubled(v)).otherwise(v))
    )
    return F.pmod(F.lit(10) - F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10, F.lit(10))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an alphanumeric string read as in ISO 7064 (A is 10)."""

    def step(s: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _number(m: Column, key: str) -> Column:
    """Numbers with a right check digit get another payload and its check digit; others are no card's and stay."""

    def run(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        new = lambda: _bind(permute_digits(body, key, "number"), lambda b: F.concat(b, luhn(b).cast("string")))
        return F.when(F.right(d, F.lit(1)).cast("int") == luhn(body), _refill(m, new(), "[0-9]")).otherwise(m)

    return _bind(_digits(m), run)


def _phone(m: Column, key: str) -> Column:
    """All digits but those of a country code after '+' are permuted."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    rest = F.substr(m, F.length(code) + 1)
    # '+15550100' without a separator: nine or more digits may stand together, the code then stays short
    return F.concat(code, _refill(rest, permute_digits(_digits(rest), key, "phone"), "[0-9]"))


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, "[.]")
    part = lambda i: o[i].cast("long") * 256 + o[i + 1].cast("long")
    pair = permute_pair(part(0), part(2), F.lit(65536), F.lit(65536), key, "ip")
    octets = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return _bind(pair, lambda p: F.concat_ws(".", *octets(p.l), *octets(p.r)))


def _date(m: Column, day: Column, key: str, write) -> Column:
    """A real date of the range is permuted among its days; anything else isn't a date and stays."""
    a, b = DAYS
    n = F.datediff(day, F.lit("1800-01-01").cast("date"))
    pair = permute_pair(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, "date")
    new = _bind(pair, lambda p: F.date_add(F.lit("1800-01-01").cast("date"), (p.l * b + p.r).cast("int")))
    return F.when(n.between(0, a * b - 1), _bind(new, write)).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    """A valid IBAN gets permuted letters and digits and a new checksum; an invalid one stays."""

    def run(c: Column) -> Column:
        body = permute_string(F.lower(F.substr(c, F.lit(5))), key, "iban")
        land = F.substr(c, F.lit(1), F.lit(2))
        whole = lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b)
        valid = _mod97(F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))) == 1
        return F.when(valid, _refill(m, _bind(F.upper(body), whole), "[A-Z0-9]")).otherwise(m)

    return _bind(F.regexp_replace(m, " ", ""), run)


def _ssn(m: Column, key: str) -> Column:
    """Area 1..899 without 666, group 1..99, serial 1..9999: permuted among the valid numbers."""
    p = F.split(m, "-")
    area = p[0].cast("long")
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + p[1].cast("long") - 1
    pair = permute_pair(left, p[2].cast("long") - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def write(q: Column) -> Column:
        area = F.floor(q.l / 99)
        return F.concat_ws("-", pad(area + F.when(area >= 665, 2).otherwise(1), 3), pad(q.l % 99 + 1, 2), pad(q.r + 1, 4))

    return _bind(pair, write)


def _email(m: Column, key: str) -> Column:
    """The part before '@' is permuted, with the case of its letters kept; the domain stays."""
    lead = F.regexp_extract(m, r"^[._%+\-]*", 0)
    local = F.substr(F.substring_index(m, "@", 1), F.length(lead) + 1)
    new = permute_string(F.lower(local), key, "email")
    cased = F.when(local == F.upper(local), F.upper(new)).when(local == F.lower(local), new).otherwise(F.initcap(new))
    return F.concat(lead, cased, F.substr(m, F.length(lead) + F.length(local) + 1))


def _secret(m: Column, key: str) -> Column:
    new = permute_string(F.lower(m), key, "secret", "hex")
    return F.when(m == F.upper(m), F.upper(new)).otherwise(new)


def _apikey(m: Column, key: str) -> Column:
    """What follows the prefix is permuted in lower case; letters are capital where they were."""
    prefix = F.regexp_extract(m, f"^{KEY_PREFIX}", 0)
    rest = F.substr(m, F.length(prefix) + 1)
    cased = lambda new: F.zip_with(F.split(rest, ""), F.split(new, ""), lambda old, c: F.when(old.rlike("[A-Z]"), F.upper(c)).otherwise(c))
    return F.concat(prefix, F.array_join(cased(permute_string(F.lower(rest), key, "apikey")), ""))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value, by its kind."""
    is_ = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    iso = F.try_to_date(m, "yyyy-MM-dd")
    day = F.try_to_date(F.regexp_replace(m, "[./]", "-"), "dd-MM-yyyy")
    mark = F.substr(m, F.lit(3), F.lit(1))
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(is_("secret"), _secret(m, key))
        .when(is_("apikey"), _apikey(m, key))
        .when(is_("iban"), _iban(m, key))
        .when(is_("phone"), _phone(m, key))
        .when(is_("ip"), _ip(m, key))
        .when(is_("isodate"), _date(m, iso, key, lambda d: F.date_format(d, "yyyy-MM-dd")))
        .when(is_("daydate"), _date(m, day, key, lambda d: F.concat_ws("", F.date_format(d, "dd"), mark, F.date_format(d, "MM"), F.substr(m, F.lit(6), F.lit(1)), F.date_format(d, "yyyy"))))
        .when(is_("ssn"), _ssn(m, key))
        .when(is_("phone10"), _refill(m, permute_digits(_digits(m), key, "phone"), "[0-9]"))
        .when(is_("number"), _number(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pii") -> DataFrame:
    """The rows with found values in `text_col` replaced, and their number in `count_col` (added or replaced).

    Null texts stay null (0 found); empty texts stay empty; repeated rows are treated alike, whatever
    their ids; an empty table stays empty. All other columns stay, whatever their names.
    """
    text, m_ = F.col(text_col), f"m_{uuid.uuid4().hex}"
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    some = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    out = docs.withColumn(m_, F.when(some, found).otherwise(F.array().cast("array<string>")))
    parts = F.zip_with(
        F.split(text, ANY, -1),
        F.concat(F.transform(m_, lambda m: pseudonym(m, key)), F.array(F.lit(""))),
        lambda piece, m: F.concat(piece, m),
    )
    out = out.withColumn(text_col, F.when(F.size(m_) > 0, F.array_join(parts, "")).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.size(m_))
    return out.drop(m_)


#: For the query and the tests; a production job passes its own secret.
KEY = "example key"


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document with its personal data replaced by pseudonyms."""
    from quillgrain.llm.common import table

    return pseudonymise(table(spark, sf_dir, "documents"), KEY)
