"""Secrets in texts: fixed patterns, and a battery of randomness tests, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import cut, free_names, text_or_empty

# The base patterns, whose failing matches are dropped after the search.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Kinds in the order of equal starts.
KINDS = ("assign", "access", "hex", "random")

#: What the randomness tests look at: runs of the characters of the usual encodings, of this length at least.
LEAST_RANDOM = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_RANDOM},}}"
BITS = 50  # bins of -log10 p are 1/50 wide
MOST_BIN = 1000


@dataclass(frozen=True)
class Encoding:
    """An alphabet and how words, identifiers and numbers written in it differ from random symbols."""

    name: str
    pattern: str
    alphabet: str
    unevenness: float  # size of the alphabet times the chance that two symbols are equal, less 1
    changes: float  # share of neighbours of different classes (upper, lower, digit, sign)
    correlation: float  # of a symbol's number with the next one's


RUN, REPEATED = r"(.)\\1*", r"\\b([a-z0-9]+) (?=\\1\\b)"  # as SQL spells them
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Decimal numbers are the even-most text in hexadecimal digits; letters of one case, as common as in prose, in the others.
ENCODINGS = (
    Encoding("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.6, 0.25, 0.3),
    Encoding("base32", "^[A-Z2-7]+$", UPPER + "234567", 1.13, 0.20, 0.3),
    Encoding("base64", ".", UPPER + LOWER + DIGITS + "+/", 3.27, 0.30, 0.3),
)

#: Lengths from which another stratum of the false-discovery control begins.
LENGTHS = (20, 24, 32, 40, 48, 64, 96)


def _occurrences(text: str, pattern: str, keep: str = "true") -> Column:
    """array of (start, end, m) of the leftmost non-overlapping matches m for which keep holds; places in code points.

    Splitting at the pattern gives what lies between the matches, so lengths add up to places.
    """
    literal = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"regexp_extract_all({text}, {literal}, 0)"
    # places are running sums; by blocks of 256 matches, as each sum copies what it has found so far
    pairs = f"zip_with({found}, slice(split({text}, {literal}), 1, size({found})), (m, gap) -> struct(length(gap) AS gap, m AS m))"
    empty = "cast(array() AS array<struct<start:int,end:int,m:string>>)"
    block = (
        f"aggregate(slice(ps, b * 256 + 1, 256), struct(element_at(ats, cast(b + 1 AS int)) AS at, {empty} AS found), "
        "(acc, x) -> struct(acc.at + x.gap + length(x.m) AS at, concat(acc.found, array(struct(acc.at + x.gap AS start, acc.at + x.gap + length(x.m) AS end, x.m AS m))) AS found)).found"
    )
    numbers = "sequence(0, cast((size(ps) - 1) div 256 AS int))"
    sums = f"transform({numbers}, b -> aggregate(slice(ps, b * 256 + 1, 256), 0, (acc, x) -> acc + x.gap + length(x.m)))"
    upto = f"aggregate({sums}, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))"
    walk = f"element_at(transform(array({pairs}), ps -> element_at(transform(array({upto}), ats -> flatten(transform({numbers}, b -> {block}))), 1)), 1)"
    none = "cast(array() AS array<struct<start:int,end:int,m:string>>)"
    return F.expr(f"CASE WHEN {text} RLIKE {literal} THEN filter({walk}, o -> {keep.replace('$literal', literal)}) ELSE {none} END")


def _normal(z: str) -> str:
    """The chance that a standard normal number is below z; by the logistic form of Bowling and others, to 1.4e-4 relative to 1."""
    return f"(1D / (1D + exp(-greatest(-60D, least(60D, 0.07056D * pow({z}, 3) + 1.5976D * ({z}))))))"


def _chi(e: Encoding, n: str, squares: str) -> str:
    size = len(e.alphabet)
    return f"(({size}D / {n} * {squares} - {n} - ({size - 1}D + {n} * {e.unevenness}D)) / sqrt(2D * ({size - 1}D + 2D * {n} * {e.unevenness}D)))"


def _turns(e: Encoding, n: str, turns: str) -> str:
    return f"(({turns} - ({n} - 1D) * {e.changes}D) / sqrt(({n} - 1D) * {e.changes * (1 - e.changes)}D))"


def _serial(e: Encoding, n: str, correlation: str) -> str:
    return f"((coalesce({correlation}, 1D) - {e.correlation}D) * sqrt({n} - 1D))"


def _fisher(chi: str, turns: str, serial: str) -> str:
    """Fisher's sum of three -ln p, half a chi-squared number with six degrees of freedom."""
    return f"(-ln({_normal(chi)}) - ln({_normal(f'-{turns}')}) - ln({_normal(serial)}))"


def _upper_tail(h: str) -> str:
    return f"(exp(-{h}) * (1D + {h} + {h} * {h} / 2D))"


SERIAL = (  # of t.s with the next ones, whose mean is t.mean
    "try_divide(aggregate(zip_with(t.s, slice(t.s, 2, size(t.s) - 1), (x, y) -> if(y IS NULL, 0D, (x - t.mean) * (y - t.mean))), 0D, (a, x) -> a + x), "
    "aggregate(t.s, 0D, (a, x) -> a + pow(x - t.mean, 2)))"
)


def _p_value(token: str, e: Encoding) -> str:
    """The chance of a token at least as random as this one among words and numbers of its length, from three tests.

    chi-squared: the symbols' evenness against a non-central law; runs: neighbours of different classes
    against the expected share; serial correlation at lag 1. Fisher's method combines them.
    """
    shown = f"lower({token})" if e.name == "hex" else f"translate({token}, '-_', '+/')"
    symbols = f"transform(split({shown}, ''), c -> cast(instr('{e.alphabet}', c) - 1 AS double))"
    classes = f"translate({shown}, '{LOWER}{UPPER}{DIGITS}', '{'a' * 26}{'A' * 26}{'0' * 10}')"
    # runs of equal characters, of the sorted symbols: as many as there are of each
    equal = f"regexp_extract_all(array_join(sort_array(split({shown}, '')), ''), '{RUN}', 0)"
    stats = (
        f"transform(array({symbols}), s -> struct(s AS s, cast(size(s) AS double) AS n, aggregate(s, 0D, (a, x) -> a + x) / size(s) AS mean, "
        f"aggregate({equal}, 0D, (a, x) -> a + length(x) * length(x)) AS squares, "
        f"cast(size(regexp_extract_all({classes}, '{RUN}', 0)) - 1 AS double) AS turns))"
    )
    tests = f"transform({stats}, t -> struct(t.n AS n, {_chi(e, 't.n', 't.squares')} AS chi, {_turns(e, 't.n', 't.turns')} AS turns, {_serial(e, 't.n', SERIAL)} AS serial))"
    fisher = f"transform({tests}, z -> {_fisher('z.chi', 'z.turns', 'z.serial')})"
    return f"element_at(transform({fisher}, h -> {_upper_tail('h')}), 1)"


def _candidates(tokens: str = "_r") -> Column:
    """(start, end, h, stratum, bin) of a column's tokens: the inferred encoding and the length tell the stratum, the bin is -log10 p."""
    p = "CASE " + " ".join(f"WHEN o.m RLIKE '{e.pattern}' THEN {_p_value('o.m', e)}" for e in ENCODINGS[:-1]) + f" ELSE {_p_value('o.m', ENCODINGS[-1])} END"
    code = "CASE " + " ".join(f"WHEN o.m RLIKE '{e.pattern}' THEN {i}" for i, e in enumerate(ENCODINGS[:-1])) + f" ELSE {len(ENCODINGS) - 1} END"
    return F.expr(f"transform({tokens}, o -> struct(o.start AS start, o.end AS end, xxhash64(o.m) AS h, ({code}) * 100 + {_longer('length(o.m)')} AS stratum, {_bin(p)} AS bin))")


def _longer(n: str) -> str:
    return " + ".join(f"cast({n} >= {least} AS int)" for least in LENGTHS)


def _bin(p: str) -> str:
    return f"cast(least({MOST_BIN}, floor(-log10(greatest({p}, 1e-300D)) * {BITS})) AS int)"


def _cuts() -> str:
    """(at, n) of the tokens in as many characters as the lengths have together, by the hash of column _t."""
    turns = [[(LENGTHS[(k + i) % len(LENGTHS)]) for i in range(len(LENGTHS))] for k in range(len(LENGTHS))]
    turn = ", ".join("array(" + ", ".join(f"struct({1 + sum(t[:i])} AS at, {n} AS n)" for i, n in enumerate(t)) + ")" for t in turns)
    return f"element_at(array({turn}), 1 + cast(pmod(xxhash64(_t), {len(LENGTHS)}) AS int))"


def _plain_tokens() -> Column:
    """Tokens that are no secrets, made of all of column _t's own words and numbers outside of the tokens under test: words joined
    as in identifiers, in capitals and by underscores, and digits. A word or number several times in a row counts once, as to the tests ababab is random.

    Each of these is cut from end to end into tokens of the lengths in turn; the text's hash tells which comes first, so
    that short texts have long tokens too. What is left at the end has the longest that fit, and its last characters
    are of the last token.
    """
    longest = "|".join(f".{{{n}}}" for n in reversed(LENGTHS))
    blocks = f"regexp_extract_all(j, '.{{1,{sum(LENGTHS)}}}', 0)"  # as places in a long text are found by counting
    pieces = f"flatten(transform({blocks}, b -> flatten(transform(cuts, c -> regexp_extract_all(substring(b, c.at, c.n), '{longest}', 0)))))"
    tokens = f"if(length(j) < {LEAST_RANDOM}, cast(array() AS array<string>), array_append({pieces}, right(j, {LEAST_RANDOM})))"
    once = lambda kept: f"trim(regexp_replace(lower(regexp_replace(regexp_replace(_t, '{CANDIDATE}', ' '), '[^{kept}]+', ' ')), '{REPEATED}', ''))"
    joined = f"array(replace(initcap(ws), ' ', ''), upper(replace(ws, ' ', '')), replace(ws, ' ', '_'), replace({once('0-9')}, ' ', ''))"
    every = f"flatten(transform(array({_cuts()}), cuts -> flatten(transform(array({once('A-Za-z')}), ws -> flatten(transform({joined}, j -> {tokens}))))))"
    return F.expr(f"transform({every}, m -> struct(0 AS start, 0 AS end, m AS m))")


#: Symbols of letters' tokens are told by two decimal digits, which as a byte's hexadecimal ones read as a number eight symbols long.
#: 0 is none, 1 to 26 small letters and 27 their gap, 28 to 53 capitals.
GAP = 27
LONGEST, CHUNK = max(LENGTHS), 8
FLAG = 20  # bits below the flag of a change of class: a capital, or the gap


def _symbol_tables() -> dict[str, list[int]]:
    """By symbol: z is the place among letters, with the flag; k0 to k2 count letters of either case in nine fields of seven bits each, c0 to c2 capitals."""
    gap = len(ENCODINGS[-1].alphabet) - 1 - 26 + (1 << FLAG)  # base64 shows it as its last symbol
    letter = [*range(GAP), *range(26)]
    count = lambda j, least: [0] + [(1 << 7 * (x % 9)) * (x // 9 == j and i >= least) for i, x in enumerate(letter)]
    return {"z": [0, *range(26), gap, *(i + (1 << FLAG) for i in range(26))], **{f"k{j}": count(j, 0) for j in range(3)}, **{f"c{j}": count(j, GAP) for j in range(3)}}


def _places(n: str) -> str:
    """(at, n) of the tokens that _plain_tokens cuts from n characters, by the text's cuts."""
    cycle = sum(LENGTHS)

    def rest(left: int) -> list[tuple[int, int]]:  # of the token that does not fit any more
        at, out = 0, []
        while left - at >= LEAST_RANDOM:
            out.append((at, max(k for k in LENGTHS if k <= left - at)))
            at += out[-1][1]
        return out

    none = "cast(array() AS array<struct<at:int,n:int>>)"
    rests = "array(" + ", ".join("array(" + ", ".join(f"struct({at} AS at, {k} AS n)" for at, k in rest(left)) + ")" if rest(left) else none for left in range(LONGEST)) + ")"
    whole = f"flatten(transform(sequence(0, ({n} - 1) div {cycle}), b -> transform(filter(cuts, c -> cast(b * {cycle} AS int) + c.at - 1 + c.n <= {n}), c -> struct(cast(b * {cycle} AS int) + c.at AS at, c.n AS n))))"
    last = f"cast(({n} - 1) div {cycle} * {cycle} AS int)"
    broken = f"filter(cuts, c -> {last} + c.at <= {n} AND {last} + c.at - 1 + c.n > {n})"
    partly = f"flatten(transform({broken}, c -> transform(element_at({rests}, {n} - {last} - c.at + 2), r -> struct({last} + c.at + r.at AS at, r.n AS n))))"
    return f"array_append(concat({whole}, {partly}), struct({n} - {LEAST_RANDOM - 1} AS at, {LEAST_RANDOM} AS n))"


def _plain_bins(text: DataFrame) -> DataFrame:
    """(stratum, bin, h) of _candidates of _plain_tokens of column _t, a row a token.

    Array functions take a microsecond a character for that, and there are twice as many as in the texts. Here a token is
    a row and its sums are columns, which Spark compiles: letters and gaps are read as numbers, eight at once, and looked
    up in tables, and tokens in capitals share the sums of the identifiers they are cut along with. Tokens of digits
    only, or that may be taken for another encoding, are few and go the other way.
    """
    _, base32, base64 = ENCODINGS
    shown = [chr(int(f"{i:02d}", 16)) for i in range(1 + GAP + 26)]
    literal = lambda cs: "decode(unhex('" + "".join(f"{ord(c):02x}" for c in cs) + "'), 'UTF-8')"
    said = f"'{LOWER} {UPPER}', {literal(shown[1:])}"
    # as _plain_tokens has them
    apart = text.select("_t", F.expr(f"regexp_replace(_t, '(?<![A-Za-z0-9+/_-]){CANDIDATE}', ' ')").alias("rest"))
    once = lambda kept: f"trim(regexp_replace(lower(regexp_replace(rest, '[^{kept}]+', ' ')), '{REPEATED}', ''))"
    words = apart.select(F.expr(_cuts()).alias("cuts"), F.expr(once("A-Za-z")).alias("ws"), F.expr(f"replace({once('0-9')}, ' ', '')").alias("ds"))
    titled = words.select("cuts", "ws", "ds", F.expr("replace(initcap(ws), ' ', '')").alias("title"), F.expr("replace(ws, ' ', '_')").alias("gapped"))
    # a text's bytes are held once while all its tokens are cut
    cut_up = lambda j, y, gaps: (
        f"if(length({j}) < {LEAST_RANDOM}, cast(array() AS array<struct<m:string,y:binary,n:int,gaps:boolean>>), flatten(transform(array(struct(cast({j} AS binary) AS j, cast({y} AS binary) AS y, length({j}) AS n)), "
        f"s -> transform({_places('s.n')}, p -> struct(cast(substring(s.j, p.at, p.n) AS string) AS m, substring(s.y, p.at, p.n) AS y, p.n AS n, {gaps} AS gaps)))))"
    )
    pieces = titled.select(F.expr(f"concat({cut_up('title', f'translate(title, {said})', 'false')}, {cut_up('gapped', f'translate(ws, {said})', 'true')}, {cut_up('ds', 'ds', 'false')})").alias("pieces"))
    tokens = pieces.select(F.expr("inline_outer(pieces)")).where("m IS NOT NULL").select(  # a plain inline has Spark cut all texts once more, to leave out empty ones first
        "m", "n", "gaps", F.expr(f"rpad(y, {LONGEST}, X'00')").alias("y"), F.expr("m RLIKE '^([A-Z]+|[A-Fa-f]+|[0-9]+)$'").alias("odd"))
    chunks = range(LONGEST // CHUNK)
    said_as = lambda at, n: f"cast(hex(substring(y, {at}, {n})) AS long)"
    numbers = tokens.withColumn("digits", F.expr("m RLIKE '^[0-9]+$'")).select(
        "m", "n", "gaps", "odd", "digits", *[F.expr(f"if(n > {c * CHUNK} AND NOT digits, {said_as(c * CHUNK + 1, CHUNK)}, 0L)").alias(f"p{c}") for c in chunks],
        F.expr(f"cast(if(digits, 0L, {said_as('n', 1)}) AS int)").alias("last"),
    )
    tables = _symbol_tables()
    symbol = lambda i: f"cast(p{i // CHUNK} div {100 ** (CHUNK - 1 - i % CHUNK)}L % 100L AS int)"
    symbols = numbers.select(
        "m", "n", "gaps", "odd", "digits", "last", *[F.expr(symbol(i)).alias(f"y{i}") for i in range(LONGEST)],
        *[F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")").alias(f"of_{t}") for t, values in tables.items()],
    )
    added = lambda f: " + ".join("if(n > {}, {}, 0L)".format(c * CHUNK, " + ".join(f(i) for i in range(c * CHUNK, (c + 1) * CHUNK))) for c in chunks)
    placed = symbols.select(
        "m", "n", "gaps", "odd", "digits", F.expr("of_z[last]").alias("zn"), *[F.expr(f"of_z[y{i}]").alias(f"z{i}") for i in range(LONGEST)],
        *[F.expr(added(lambda i: f"of_{t}[y{i}]")).alias(t) for t in tables if t != "z"],  # noqa: B023
    )
    sums = placed.select(
        "m", "n", "gaps", "odd", "digits", "z0", "zn", *[t for t in tables if t != "z"],
        F.expr(added(lambda i: f"z{i}")).alias("z"), F.expr(added(lambda i: f"z{i} * z{i}")).alias("zz"), F.expr(added(lambda i: f"z{i} * z{i + 1}" if i + 1 < LONGEST else "0L")).alias("zy"),
    )
    field = lambda c, at, bits=FLAG: f"(shiftright({c}, {at}) & {(1 << bits) - 1}L)"
    of = {
        "u": field("z", 0), "f": field("z", FLAG), "uu": field("zz", 0, FLAG + 1), "uf": field("zz", FLAG + 1, FLAG - 1), "uy": field("zy", 0), "uyf": field("zy", FLAG), "ff": field("zy", 2 * FLAG),
        "u1": field("z0", 0), "f1": field("z0", FLAG), "un": field("zn", 0), "fn": field("zn", FLAG),
        **{f"{name}": " + ".join(f"{field(c.format(j), 7 * i, 7)} * {field(c.format(j), 7 * i, 7)}" for j in range(3) for i in range(9)) for name, c in (("any", "k{}"), ("small", "(k{0} - c{0})"), ("large", "c{}"))},
    }
    parts = sums.select("m", "gaps", "n", "odd", "digits", *[F.expr(x).alias(name) for name, x in of.items()])
    # a capital's place is 26 below its small letter's
    each = (
        "if(NOT gaps AND NOT digits, array("
        "struct(m, false AS up, small + large AS squares, 2 * (f - ff) - f1 - fn AS turns, u - 26 * f AS s, uu - 52 * uf + 676 * f AS ss, uy - 26 * uyf + 676 * ff AS sy, u1 + un - 26 * (f1 + fn) AS ends), "
        "struct(upper(m) AS m, true AS up, any AS squares, 0L AS turns, u AS s, uu AS ss, uy AS sy, u1 + un AS ends)), "
        "array(struct(m, false AS up, any AS squares, 2 * (f - ff) - f1 - fn AS turns, u AS s, uu AS ss, uy AS sy, u1 + un AS ends)))"
    )
    one = parts.select("n", "odd", F.expr(f"inline_outer({each})"))
    way = lambda f, *xs: f"if(up, {f(base32, *xs)}, {f(base64, *xs)})"
    alike = "try_divide(cast(n * (n * sy - s * (2 * s - ends)) + (n - 1) * s * s AS double), cast(n * (n * ss - s * s) AS double))"
    z = one.select("m", "n", "odd", "up", *[F.expr(x).alias(name) for name, x in (("chi", way(_chi, "n", "squares")), ("runs", way(_turns, "n", "turns")), ("serial", way(_serial, "n", alike)))])
    h = z.select("m", "n", "odd", "up", F.expr(_fisher("chi", "runs", "serial")).alias("fisher"))
    other = h.select("m", "n", "up", "fisher", F.when(F.col("odd"), F.expr("array(struct(0 AS start, 0 AS end, m AS m))")).alias("_o"))
    strata = f"if(up, {ENCODINGS.index(base32)}, {ENCODINGS.index(base64)}) * 100 + {_longer('n')}"
    done = other.select(F.element_at(_candidates("_o"), 1).alias("o"), F.expr("xxhash64(m)").alias("h"), F.expr(strata).alias("stratum"), F.expr(_bin(_upper_tail("fisher"))).alias("bin"))
    return done.select(F.coalesce("o.stratum", "stratum").alias("stratum"), F.coalesce("o.bin", "bin").alias("bin"), "h")


def _thresholds(tokens: DataFrame, plain: DataFrame, rate: float, least_seen: int = 10) -> dict[int, int]:
    """The least bin of each stratum that may be told a secret: Benjamini and Hochberg's rule at the rate.

    tokens and plain: a row a token, (stratum, bin, h). A stratum is one encoding and range of lengths, as short tokens
    tell less. Each distinct token counts once. The tests are not independent on one token, and a corpus's words have
    their own letters, so the chance of a bin is no less than the share of the corpus's plain tokens that reach it.
    Beyond the last bin that least_seen of them reach, their share is taken to fall as the law does, so more plain
    tokens make it more exact, and not higher. Strata times bins bound all rows here, whatever the input.
    """

    def counted(found: DataFrame, name: str) -> DataFrame:
        return found.select("stratum", "bin", "h").distinct().groupBy("stratum", "bin").agg(F.count("*").alias(name))

    bins = counted(tokens, "n").join(counted(plain, "p"), ["stratum", "bin"], "full").fillna(0, ["n", "p"])
    whole = Window.partitionBy("stratum")
    down = whole.orderBy(F.desc("bin"))
    share = lambda c: F.coalesce(F.try_divide(F.sum(c).over(down), F.sum(c).over(whole)), F.lit(0.0))
    tails = bins.select("stratum", "bin", F.pow(F.lit(10.0), -F.col("bin") / BITS).alias("law"), "n", share("n").alias("tokens"), share("p").alias("plain"), F.sum("p").over(down).alias("seen"))
    last = lambda c: F.min(F.when(F.col("seen") >= least_seen, F.col(c))).over(whole)
    own = F.when(F.col("seen") >= least_seen, F.col("plain")).otherwise(last("plain") * F.least(F.lit(1.0), F.col("law") / last("law")))
    chances = tails.select("stratum", "bin", "n", "tokens", F.greatest("law", own).alias("chance"))
    passing = chances.where((F.col("n") > 0) & (F.col("chance") <= rate * F.col("tokens")))
    return {r["stratum"]: r["bin"] for r in passing.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """(doc_id, tag, spans): an array of (start, kind, end) of each row's secrets, by start and kind; kind is a place in KINDS.

    tag is the XXH64 of the text, for joining on.
    Null texts are empty. Tokens that the tests find random among all rows' tokens, at a share of false
    ones of rate, are added where no base span covers them. Texts are read twice: for the spans and tokens,
    from whose checkpoint all else goes on, and for the plain tokens, which are many and are only counted. Repeated rows and rows without an id are scanned like any other.
    """
    text = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t"))
    raw = text.select(
        "doc_id",
        F.xxhash64("_t").alias("tag"),
        _occurrences("_t", ASSIGN, f"length(regexp_extract(o.m, $literal, 2)) >= {LEAST_VALUE}").alias("_a"),
        _occurrences("_t", ACCESS + "", f"length(o.m) >= {LEAST_ACCESS}").alias("_k"),
        _occurrences("_t", HEX[:-1] + f"{{{LEAST_HEX},}}").alias("_h"),  # as long runs of hexadecimal digits as match at all
        _occurrences("_t", CANDIDATE).alias("_r"),
    )
    base = ", ".join(f"transform({c}, o -> struct(o.start AS start, {i} AS kind, o.end AS end))" for i, c in enumerate(("_a", "_k", "_h")))
    found = cut(raw.select("doc_id", "tag", F.expr(f"array_sort(concat({base}))").alias("base"), _candidates().alias("tokens")))
    least = _thresholds(found.select(F.inline("tokens")), _plain_bins(text), rate)
    random = "false"
    if least:
        random = "coalesce(t.bin >= element_at(map(" + ", ".join(f"{k}, {v}" for k, v in sorted(least.items())) + "), t.stratum), false)"
    added = f"transform(filter(tokens, t -> {random} AND NOT exists(base, b -> b.start < t.end AND t.start < b.end)), t -> struct(t.start AS start, {KINDS.index('random')} AS kind, t.end AS end))"
    return found.select("doc_id", "tag", F.expr(f"array_sort(concat(base, {added}))").alias("spans"))


def spelled(spans: str = "spans") -> Column:
    """kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end)), ',')")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", rate: float = 0.01) -> DataFrame:
    """df with its texts' secrets replaced by a mark, overlapping ones by one mark; rows and other columns stay."""
    key, tag, found, text, of = free_names(df, "_id", "_tag", "_spans", "_text", "_of")
    spans = scan(df, id_col, text_col, rate).where("size(spans) > 0").select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.col("spans").alias(found)).dropDuplicates([key, tag])
    merged = (
        f"aggregate({found}, struct(0 AS at, '' AS said), (acc, s) -> struct(greatest(acc.at, s.end) AS at, "
        f"if(s.start < acc.at, acc.said, concat(acc.said, substring({text}, acc.at + 1, s.start - acc.at), '{mark}')) AS said), acc -> concat(acc.said, substring({text}, acc.at + 1)))"
    )
    tagged = df.select(*[F.col(c) for c in df.columns if c != text_col], F.col(text_col).alias(text), F.xxhash64(text_or_empty(text_col)).alias(of))
    joined = tagged.join(spans, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(of) == F.col(tag)), "left")
    redacted = F.when(F.col(found).isNull(), F.col(text)).otherwise(F.expr(merged))
    return joined.select(*[redacted.alias(c) if c == text_col else F.col(c) for c in df.columns])
