"""Text functions, Column to Column; all run in the JVM, Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
MONTHS = (
    "january february march april may june july august september october november december"
    " январь января февраль февраля март марта апрель апреля май мая июнь июня июль июля август августа сентябрь сентября"
    " октябрь октября ноябрь ноября декабрь декабря januar februar märz mai juni juli oktober dezember"
).split()
UNITS = (
    r"ms|sec|s|min|h|%|€|\$|gbps|mbps|kbps|gb|mb|kb|tb|pb|ghz|mhz|khz|hz|km/h|m/s|km|mm|cm|m|kg|mg|g|kcal|cal|rpm|fps|px|dp|pt"
    r"|секунд|минут|часов|час|лет|год|нед|дней|день|кбит|мбит|гбит|кб|мб|гб|тб|км|кг|мин"
)
ABBREVIATIONS = (
    "т.е. т.д. т.п. т.к. т.н. и.о. др. пр. см. ср. стр. рис. табл. гл. п. пп. ст. рус. англ. г. гг. в. вв. руб. коп. тыс. млн. млрд."
    " проф. доц. акад. им. ул. д. кв. обл. респ. тел. напр. прим. изд. ок. мин. сек. ч. мес."
    " e.g. i.e. etc. vs. mr. mrs. ms. dr. prof. st. fig. no. vol. pp. approx. inc. ltd. co. jr. sr. cf. al."
).split()
LIVE_NOT_STARTED = "this live event will begin in a few moments|this live event has not started|premieres in"
OVERFLOW_HINTS = (
    "exceeds the available context|exceeds context|exceed the context|context length exceeded|maximum context length|exceeds context window"
    "|input length exceeds|context window|prompt is too long|too many tokens|greater than the context"
)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once; inside lambda functions Spark would repeat it at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold(values: Column, state: Column, step, kind: str, rest=None) -> Column:
    """The values that a fold gives out, as an array of ``kind``: ``step(state, value)`` is (new state, whether, what).

    ``rest(state)`` is (whether, what) comes last. An array that grows by one is copied each time, so the values are
    taken in blocks of their number's square root, whose lists are joined at the end: n^1.5 copies of references.
    """
    empty = F.expr(f"cast(array() as array<{kind}>)")

    def over(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), width)).otherwise(F.expr("cast(array() as array<int>)"))

        def one(b: Column, x: Column) -> Column:
            new, gives, what = step(b["state"], x)
            return F.struct(new.alias("state"), F.when(gives, F.concat(b["out"], F.array(what))).otherwise(b["out"]).alias("out"))

        def block(a: Column, at: Column) -> Column:
            start = F.struct(a["state"].alias("state"), empty.alias("out"))
            return F.aggregate(F.slice(xs, at, width), start, one, lambda b: F.struct(b["state"].alias("state"), F.concat(a["done"], F.array(b["out"])).alias("done")))

        def close(a: Column) -> Column:
            done = F.flatten(a["done"])
            if rest is None:
                return done
            gives, what = rest(a["state"])
            return F.when(gives, F.concat(done, F.array(what))).otherwise(done)

        return F.aggregate(starts, F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("done")), block, close)

    return let(values, over)


def strip(c: Column) -> Column:
    """Remove all Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def estimate_tokens(c: Column) -> Column:
    """At least 1, a token for every four characters."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def split_sentences(c: Column) -> Column:
    """Sentences for metrics: cut after . ! ? … before white space, and at empty lines."""
    return _pieces(F.split(c, r"(?U)(?<=[.!?…])\s+|\n{2,}"))


def transcript_sentences(c: Column) -> Column:
    """Sentences of a transcript: no rule for empty lines."""
    return _pieces(F.split(c, r"(?U)(?<=[.!?…])\s+"))


def normalize_token(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[^\w]+", ""))


def word_ngrams(words: Column, n: int) -> Column:
    """Shingles of n words; fewer words give the words themselves."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1))
    return F.when(F.size(words) < n, words).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")


def hash64(c: Column) -> Column:
    """A hash that other engines can compute, too: the first 16 hexadecimal digits of MD5, as a signed long."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 16), 16, -10).cast("long")


def simhash(tokens: Column, hashed=hash64, fits: int = 1 << 22) -> Column:
    """64-bit SimHash over token hashes: a bit is set if more tokens have it than not; no tokens give 0.

    The set bits are counted three at a time, in fields of 22 bits of a long, so a token costs 22 additions. The fields
    hold 4,194,303 tokens; of more, the bits are counted one by one.
    """
    fields = F.lit(1 | 1 << 22 | 1 << 44).cast("long")
    low = F.lit((1 << 22) - 1).cast("long")

    def fold(hashes: Column) -> Column:
        counts = F.transform(
            F.sequence(F.lit(0), F.lit(21)),
            lambda k: F.struct(k.alias("k"), F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, k).bitwiseAND(fields)).alias("n")),
        )

        def bit(x: Column, f: int) -> Column:
            more = F.shiftrightunsigned(x["n"], 22 * f).bitwiseAND(low) * 2 > F.size(hashes)  # bits 64 and 65 are never set
            return F.when(more, F.call_function("shiftleft", F.lit(1).cast("long"), x["k"] + 22 * f)).otherwise(F.lit(0).cast("long"))

        packed = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x, 0)).bitwiseOR(bit(x, 1)).bitwiseOR(bit(x, 2)))
        return F.when(F.size(hashes) < fits, packed).otherwise(one_by_one(hashes))

    def one_by_one(hashes: Column) -> Column:
        one = F.lit(1).cast("long")
        each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.struct(k.alias("k"), F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, k).bitwiseAND(one)).alias("n")))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.when(x["n"] * 2 > F.size(hashes), F.call_function("shiftleft", one, x["k"])).otherwise(F.lit(0).cast("long"))))

    return let(F.transform(tokens, hashed), fold)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def repeats_before(hashes: Column, most: int = 3) -> Column:
    """For each element whether an earlier one is within ``most`` bits."""
    return let(hashes, lambda hs: F.transform(hs, lambda h, i: F.exists(F.slice(hs, 1, i), lambda e: F.bit_count(e.bitwiseXOR(h)) <= most)))


def sentence_hashes(sentences: Column, n: int = 3) -> Column:
    """The 64-bit SimHash of each sentence over its shingles of n words."""
    return F.transform(sentences, lambda s: let(words(s), lambda w: simhash(word_ngrams(w, n))))


def redundancy(c: Column, n: int = 3, most: int = 3) -> Column:
    """Share of sentences that nearly repeat an earlier one; fewer than two sentences give 0.

    Compares all sentences of a text, so it is for short texts; ``sequences.repeat_share`` does the same for long ones.
    """
    sentences = split_sentences(c)
    hashes = sentence_hashes(sentences, n)
    return F.when(F.size(sentences) < 2, 0.0).otherwise(F.size(F.filter(repeats_before(hashes, most), lambda x: x)) / F.size(sentences))


def normalize_number(c: Column) -> Column:
    """Without white space, and without separators of thousands."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", ""), r"(?U)[,.](?=\d{3}(?!\d))", "")


def _with_digits(c: Column, found: Column) -> Column:
    """What a text without any digit can't have isn't looked for; null texts give null."""
    return F.when(c.rlike(r"(?U)\d"), found).when(c.isNotNull(), F.expr("cast(array() as array<string>)"))


def extract_numbers(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?U)-?\b\d+(?:[.,\s]\d+)*\b"), 0)
    return _with_digits(c, F.array_distinct(F.filter(F.transform(found, normalize_number), lambda x: ~x.isin("", "-"))))


def extract_dates(c: Column) -> Column:
    named = "|".join(MONTHS)
    forms = [r"(?U)\b\d{4}-\d{2}-\d{2}\b", r"(?U)\b\d{1,2}\.\d{1,2}\.\d{4}\b", r"(?U)\b\d{1,2}/\d{1,2}/\d{4}\b"]
    found = [F.regexp_extract_all(c, F.lit(f), 0) for f in forms]
    found.append(F.transform(F.regexp_extract_all(c, F.lit(rf"(?iU)\b\d{{1,2}}\s+(?:{named})\b|\b(?:{named})\s+\d{{1,4}}\b"), 0), F.lower))
    return _with_digits(c, F.array_distinct(F.concat(*found)))


def extract_units(c: Column) -> Column:
    """Values with their unit, normalised and in lower case."""
    form = rf"(?iU)(-?\d+(?:[.,]\d+)?)\s*({UNITS})(?!\w)"
    found = F.regexp_extract_all(c, F.lit(form), 0)  # the parts are taken from the short matches
    parts = F.transform(found, lambda m: F.concat(normalize_number(F.regexp_extract(m, form, 1)), F.lower(F.regexp_extract(m, form, 2))))
    return _with_digits(c, F.array_distinct(parts))


def lines(c: Column) -> Column:
    """Lines, a line end at the very end ignored; an empty text has none."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n"))


def format_metrics(c: Column) -> Column:
    """Paragraphs, share of bullet lines, headings, and an array of violations that stays empty; each is one search of the whole text."""
    start, space = r"(?:[\r\n]|\A)", r"[\s&&[^\r\n]]"  # of a line, in a line
    end, more = r"[\r\n](?<!\r(?=\n))", r"(?>\r\n|\r|\n)"  # the last character of a line end; another line end
    n = F.when(F.length(c) == 0, 0).otherwise(F.regexp_count(c, F.lit(rf"{end}(?!\z)")) + 1)
    bullets = F.regexp_count(c, F.lit(rf"(?U){start}{space}*[-*•]{space}"))
    heads = F.regexp_count(c, F.lit(rf"(?U){start}(?:{space}*#{{1,6}}{space}|[A-ZА-ЯЁ][A-ZА-ЯЁ0-9 ]{{2,}}:{space}*(?![^\r\n]))"))
    gaps = F.regexp_count(c, F.lit(rf"(?U){end}{space}*+{more}\s*+(?!\z)"))
    first = F.when(c.rlike(rf"(?U)\A(?!{space}*+{more}{space}*+{more})\s*+(?!\z)"), 1).otherwise(0)
    return F.struct(
        (first + gaps).alias("paragraph_count"),
        F.when(n == 0, 0.0).otherwise(F.bround(bullets / n, 4)).alias("bullet_ratio"),
        heads.alias("heading_count"),
        F.array().cast("array<string>").alias("format_violations"),
    )


def measured(c: Column, tokens: Column | None = None) -> Column:
    """What is compared of a text: its tokens (``tokens`` where they are known), characters, numbers, dates and units."""
    known = estimate_tokens(c) if tokens is None else F.coalesce(tokens, estimate_tokens(c))
    facts = {"number": extract_numbers, "date": extract_dates, "unit": extract_units}
    return F.struct(known.alias("tokens"), F.length(c).alias("chars"), *(of(c).alias(name) for name, of in facts.items()))


def compared(summary: Column, source: Column, estimate: Column, repeats: Column, form: Column) -> Column:
    """The record of ``quality_record`` from what was ``measured`` of both texts, the summary's redundancy and format."""
    ratio = F.when(source["tokens"] > 0, F.bround(summary["tokens"] / source["tokens"], 4)).otherwise(0.0)
    parts = [source["tokens"].alias("transcript_tokens"), source["chars"].alias("transcript_chars"), estimate.alias("token_estimate")]
    parts += [summary["tokens"].alias("summary_tokens"), summary["chars"].alias("summary_chars"), ratio.alias("compression_ratio")]
    parts.append(F.bround(repeats, 4).alias("redundancy_dup_sentence_ratio"))
    for name in ("number", "date", "unit"):
        s, t = summary[name], source[name]
        parts += [F.size(s).alias(f"{name}s_in_summary"), F.size(t).alias(f"{name}s_in_transcript"), F.size(F.array_except(s, t)).alias(f"{name}_mismatch_count")]
    return F.struct(*parts, form.alias("format"))


def quality_record(summary: Column, source: Column, prompt_tokens: Column | None = None, completion_tokens: Column | None = None, repeats: Column | None = None) -> Column:
    """All quality measures of a summary against its source, as one struct; ``repeats`` is the summary's redundancy if it is known."""
    base = F.struct(
        measured(summary, completion_tokens).alias("summary"),
        measured(source, prompt_tokens).alias("source"),
        (prompt_tokens.isNull() if prompt_tokens is not None else F.lit(True)).alias("estimate"),
        (redundancy(summary) if repeats is None else repeats).alias("repeats"),
        format_metrics(summary).alias("form"),
    )
    return let(base, lambda z: compared(z["summary"], z["source"], z["estimate"], z["repeats"], z["form"]))


def asr_tokens(c: Column) -> Column:
    flat = F.lower(c)
    return F.filter(F.transform(F.split(flat, r"(?U)\s+"), normalize_token), lambda x: x != "")


def leading_run(items: Column) -> Column:
    """How many elements at the start equal the first."""

    def run(xs: Column) -> Column:
        other = let(F.get(xs, F.lit(0)), lambda head: F.array_position(F.transform(xs, lambda x: x == head), F.lit(False)))
        return let(other, lambda n: F.when(F.size(xs) == 0, 0).when(n == 0, F.size(xs)).otherwise(n.cast("int") - 1))

    return let(items, run)


def top_count(items: Column) -> Column:
    """The count of the most frequent element: the longest run of the sorted array."""
    run = F.aggregate(
        F.array_sort(items),
        F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best")),
        lambda a, x: F.struct(
            x.alias("last"),
            F.when(a["last"] == x, a["n"] + 1).otherwise(1).alias("n"),
            F.greatest(a["best"], F.when(a["last"] == x, a["n"] + 1).otherwise(1)).alias("best"),
        ),
    )
    return run["best"]


def is_probable_hallucination(c: Column) -> Column:
    """At least ten tokens and two of: few distinct ones, one that prevails, five equal sentences at an edge."""
    sentences = F.filter(F.transform(F.split(F.lower(c), r"[.!?…]+"), normalize_token), lambda x: x != "")
    edge = let(sentences, lambda s: (F.size(s) >= 5) & (F.greatest(leading_run(s), leading_run(F.reverse(s))) >= 5))

    def shares(t: Column) -> Column:
        few = (F.size(F.array_distinct(t)) / F.size(t) < 0.30).cast("int")
        return F.when(F.size(t) >= 10, few + (top_count(t) / F.size(t) > 0.35).cast("int")).otherwise(-9)

    return F.coalesce(let(asr_tokens(c), shares) + edge.cast("int") >= 2, F.lit(False))


def transcript_quality(c: Column) -> Column:
    tokens = asr_tokens(c)
    return F.size(F.array_distinct(tokens)).cast("double")


def accept_retry(suspicious: Column, score: Column, first_score: Column) -> Column:
    return ~suspicious | (score > first_score)


def classify_failure(c: Column) -> Column:
    return F.when(c.rlike(f"(?i){LIVE_NOT_STARTED}"), F.lit("download_live_not_started"))


def is_context_overflow(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(low.rlike(OVERFLOW_HINTS) | (low.contains("n_ctx") & low.rlike("exceed|too long|too large")), F.lit(False))


def tail_prompt(c: Column, most: int = 800) -> Column:
    text = strip(c)
    return F.when(text != "", F.substring(text, F.greatest(F.lit(1), F.length(text) - most + 1), F.lit(most)))


def normalize_language(c: Column) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def effective_language(explicit: Column, detected: Column, marker: str = "auto") -> Column:
    """An explicit language wins, then the detected one, then the marker."""
    own = normalize_language(explicit)
    return F.coalesce(F.when(own != marker, own), normalize_language(detected), F.lit(marker))


def language_gate(language: Column, probability: Column, least: float) -> Column:
    """A status: a missing language or probability is an error, and so is one below the least; 0.0 is a value."""
    return F.when(language.isNull(), "missing_language").when(probability.isNull(), "missing_probability").when(probability < least, "low_confidence").otherwise("ok")


def split_utterances(c: Column) -> Column:
    """Cut before each "label: " that opens the text or follows an empty line; what comes before the first stays."""
    return _pieces(F.split(c, r"(?U)\n\s*\n(?=[^\n:]{1,64}: )"))


def tokens_to_words(n: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(n * 0.75).cast("int"))


def render_template(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("${" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def label_word(language: Column) -> Column:
    return F.when(normalize_language(language) == "ru", F.lit("Голос")).otherwise(F.lit("Speaker"))


def timecode(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("int")
    rest = F.lpad((s % 60).cast("string"), 2, "0")
    minutes = F.floor(s / 60).cast("int")
    hours = F.floor(s / 3600).cast("int")
    long = F.concat_ws(":", hours.cast("string"), F.lpad((minutes % 60).cast("string"), 2, "0"), rest)
    return F.when(hours > 0, long).otherwise(F.concat_ws(":", minutes.cast("string"), rest))


def user_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 24)


def natural_key(c: Column) -> Column:
    """A sort key in which digit runs compare as numbers and the rest without case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p)), "")


def suffix_kind(name: Column, video: list[str], audio: list[str]) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return F.when(suffix.isin(video), "video").when(suffix.isin(audio), "audio").otherwise("unsupported")


def parse_ref(c: Column) -> Column:
    """(source, id) of "source:id"; null unless both are there."""
    ok = c.rlike("^[^:]+:.+$")
    return F.when(ok, F.struct(F.substring_index(c, ":", 1).alias("source"), F.regexp_replace(c, "^[^:]+:", "").alias("id")))


def text_slice(c: Column, offset: Column, limit: Column, cap: int = 200_000) -> Column:
    """Characters from an offset, at most ``cap``, and whether they reach the end."""
    n = F.least(limit, F.lit(cap))
    return F.struct(F.substring(c, offset + 1, n).alias("text"), F.length(c).alias("total"), (offset + n >= F.length(c)).alias("is_end"))


def parse_range(header: Column, total: Column) -> Column:
    """(offset, length) of a "bytes=a-b" or "bytes=a-" header; null for suffix, multipart or impossible ranges."""
    first = F.regexp_extract(header, r"^bytes=(\d+)-(\d*)$", 1)
    last = F.regexp_extract(header, r"^bytes=(\d+)-(\d*)$", 2)
    a = F.nullif(first, F.lit("")).cast("long")
    b = F.least(F.coalesce(F.nullif(last, F.lit("")).cast("long"), total - 1), total - 1)
    return F.when((a < total) & (b >= a), F.struct(a.alias("offset"), (b - a + 1).alias("length")))


def display_name(c: Column, most: int = 512) -> Column:
    return F.substring(F.nullif(strip(c), F.lit("")), 1, most)


def loose_boolean(c: Column, default: bool) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("1", "true", "yes", "on"), F.lit(default))
