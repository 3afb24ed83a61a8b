"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode and Python define it; plain \s in Java is ASCII only.
UNICODE_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# The default term lists of the scope filter, and the punctuation that the comment key drops.
RECOMMENDATION = ("种草", "拔草", "推荐", "测评", "实测", "亲测", "体验", "使用感", "使用体验", "真实体验", "分享", "好用", "难用", "回购", "无限回购", "避雷", "踩雷", "平替", "值得买", "值得入", "值得", "入手", "购买", "买了", "用了", "试用", "试了", "性价比", "必买", "宝藏", "安利", "不推荐", "推荐指数")
COMMERCE = ("价格", "优惠", "折扣", "活动", "链接", "旗舰店", "官方", "同款", "新品", "品牌", "店铺", "购买", "下单", "入手", "性价比", "便宜", "贵")
EXPERIENCE = ("用了", "吃了", "住了", "去了", "试了", "体验了", "买了", "穿了", "玩了", "看了", "喝了", "试用", "上手", "开箱")
COMMENT_PUNCTUATION = "[，。！？、；：,.!?;:'\"“”‘’（）()\\[\\]{}~～]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def clean_text(text: Column) -> Column:
    """Null becomes empty, each run of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{UNICODE_SPACE}+", " "))


def joined_parts(title: Column, body: Column, keep_newline: bool = True) -> Column:
    """Title and body with a newline between: parts cleaned before the join (it survives) or after (it becomes a space)."""
    if keep_newline:
        return strip(F.concat_ws("\n", clean_text(title), clean_text(body)))
    return clean_text(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))


def short_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("-", *parts), 256), 1, 16)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Spark has no Unicode normalisation."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def canonical(text: Column, normalize: bool = True) -> Column:
    """Letters, numbers and underscores in lower case; ``normalize=False`` where the text is known to be NFKC."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(F.lower(nfkc(text) if normalize else text), r"[^\p{L}\p{N}_]", "")


def overlap_key(text: Column) -> Column:
    return casefold(F.regexp_replace(text, f"{UNICODE_SPACE}+", ""))


def comment_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), f"{UNICODE_SPACE}+", ""), COMMENT_PUNCTUATION, "")


def _string_field(value: Column, path: str) -> Column:
    """The string at ``path`` of a variant; null where it is missing or no string."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(value, path, "string"))


def comment_text(comment: Column, names: tuple = ("text", "content", "comment", "comment_text", "body")) -> Column:
    """The text of a comment given as a variant: a string, or the first of the named fields that is a string (it may be empty), stripped."""
    return strip(F.coalesce(_string_field(comment, "$"), *[_string_field(comment, f"$.{n}") for n in names]))


def candidate_text(comment: Column, names: tuple = ("text", "content", "comment")) -> Column:
    """The same from the first named field that is not empty; numbers and other values count as their text."""
    whole = F.schema_of_variant(comment)
    other = lambda n: F.nullif(F.try_variant_get(comment, f"$.{n}", "string"), F.lit(""))
    falsy = lambda n: F.coalesce(other(n).isin("0", "false", "[]", "{}", "0.0"), F.lit(False)) & (F.schema_of_variant(F.try_variant_get(comment, f"$.{n}", "variant")) != "STRING")
    fields = F.coalesce(*[F.when(~falsy(n), other(n)) for n in names])
    return clean_text(F.when(whole == "STRING", F.try_variant_get(comment, "$", "string")).otherwise(fields))


def candidate_comments(comments: Column, least: int = 2) -> Column:
    """Cleaned texts of an array of variants, in order and with their repeats, without those under ``least`` characters."""
    return F.filter(F.transform(comments, lambda c: candidate_text(c)), lambda c: F.length(c) >= least)


def clean_comments(comments: Column, least: int = 1) -> Column:
    return F.filter(F.transform(comments, lambda c: strip(c)), lambda c: F.length(c) >= least)


def length_bucket(length: Column) -> Column:
    return F.when(length < 100, "<100").when(length < 300, "100-299").otherwise("300+")


def matched_terms(text: Column, terms: tuple) -> Column:
    """The terms that the text contains, sorted; nested terms each count."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in sorted(terms)]))


def scope(text: Column, recommendation: tuple = RECOMMENDATION, commerce: tuple = COMMERCE, experience: tuple = EXPERIENCE, least: int = 20) -> dict[str, Column]:
    """Columns recommendation_terms, commerce_terms, experience_terms, scope_score and accepted, for a cleaned text."""
    rec, com, exp = (matched_terms(text, t) for t in (recommendation, commerce, experience))
    has = lambda x, n=1: F.size(x) >= n
    score = 2 * has(rec).cast("int") + has(com).cast("int") + has(exp).cast("int") + has(rec, 2).cast("int")
    return {"recommendation_terms": rec, "commerce_terms": com, "experience_terms": exp, "scope_score": score, "accepted": (F.length(text) >= least) & (has(rec) | has(com) & has(exp))}


#: The names of the original splits, which are told apart by case, and where their rows go.
ROUTES = {"Train_1": "train", "Train_2": "train", "Train_3": "train", "Train_4": "train", "Validation": "validation", "Test": "test"}
_PRIORITY = {"train": 1, "validation": 2, "test": 3}


def split_priority(split: Column) -> Column:
    """3 for the test split, 2 for the validation split, 1 for the train splits, 0 for any other name."""
    return reduce(lambda c, kv: c.when(split == kv[0], _PRIORITY[kv[1]]), ROUTES.items(), F.when(F.lit(False), 0)).otherwise(0)


def split_route(split: Column) -> Column:
    """train, validation or test; any other name is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown split "), F.coalesce(split, F.lit("null")))).cast("string")
    return reduce(lambda c, kv: c.when(split == kv[0], kv[1]), ROUTES.items(), F.when(F.lit(False), "")).otherwise(unknown)


def risk_band(score: Column, high: Column | float = 0.60, medium: Column | float = 0.25) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def model_risk(score: Column, threshold: Column | float, high: Column | float | None = None, medium: Column | float | None = None) -> Column:
    """The band by a model's own bounds; either is the decision threshold where the model has none."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("double")
    return risk_band(score, F.coalesce(column(high), column(threshold)), F.coalesce(column(medium), column(threshold)))


def rounded(x: Column, places: int) -> Column:
    """Rounded to the nearest, halves to the even digit, on the binary value times 10 ** places."""
    return F.rint(x.cast("double") * 10.0**places) / 10.0**places


def numbered(prefix: str, n: Column, width: int) -> Column:
    """An id such as c07 or candidate_0012; longer numbers are not cut."""
    return F.format_string(f"{prefix}%0{width}d", n)


def issue_label(issue: Column) -> Column:
    """0 for no issue, 1 for a mismatch of image and text, null for the issues of other tasks."""
    return F.when(issue == "none", 0).when(issue == "image_text_mismatch", 1)


def authorship_name(label: Column) -> Column:
    """human for 0, ai_involved for 1, null for any other label."""
    return F.when(label == 0, "human").when(label == 1, "ai_involved")


def error_type(label: Column, pred: Column) -> Column:
    """false_alarm, missed_promotion, or null where the prediction is right."""
    return F.when((label == 0) & (pred == 1), "false_alarm").when((label == 1) & (pred == 0), "missed_promotion")


def log_odds(p: Column, edge: float = 1e-7) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.log(q / (1 - q))


def sigmoid(x: Column, a: Column | float = 1.0, b: Column | float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(x * a + b)))


def clip01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def valid_score(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x >= 0) & (x <= 1), F.lit(False))


def family(name: Column, of: int = 5) -> Column:
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(digits != "", F.pmod(digits.cast("long") - 1, F.lit(of)))


def redact(text: Column, secrets: list[str], limit: int = 1500) -> Column:
    return F.left(reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("[redacted]")), secrets, text), F.lit(limit))


def replace_in_order(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


#: File suffixes of image types.
IMAGE_SUFFIX = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/heic": ".heic"}


def data_url(url: Column, limit: int = 12 * 1024 * 1024) -> Column:
    """struct<status, bytes, suffix> of a base64 image URL; status is completed, bad_format, bad_base64, empty or too_large."""
    head = F.substring_index(url, ",", 1)
    body = F.when(F.contains(url, F.lit(",")), F.substring(url, F.length(head) + 2, F.length(url)))
    # Spark's decoder skips what is no base64, so the alphabet, the length and the padding are looked at first.
    strict = body.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(body) % 4 == 0)
    raw = F.when(strict, F.try_to_binary(body, F.lit("base64")))
    media = F.lower(F.substring_index(F.substring(head, 6, 1000), ";", 1))
    suffix = reduce(lambda c, kv: c.when(media == kv[0], kv[1]), IMAGE_SUFFIX.items(), F.when(F.lit(False), "")).otherwise(".img")
    status = (
        F.when(body.isNull() | ~F.startswith(head, F.lit("data:image/")) | ~F.contains(head, F.lit(";base64")), "bad_format")
        .when(raw.isNull(), "bad_base64").when(F.octet_length(raw) == 0, "empty").when(F.octet_length(raw) > limit, "too_large").otherwise("completed")
    )
    return F.struct(status.alias("status"), F.when(status == "completed", raw).alias("bytes"), F.when(status == "completed", suffix).alias("suffix"))


def upload_suffix(filename: Column, media: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"(\.[A-Za-z0-9]+)$", 1))
    by_type = reduce(lambda c, kv: c.when(F.lower(media) == kv[0], kv[1]), IMAGE_SUFFIX.items(), F.when(F.lit(False), "")).otherwise(".img")
    return F.when(ext != "", ext).otherwise(by_type)


def token_windows(n: Column, limit: int = 63, overlap: int = 8, cap: int = 16) -> Column:
    """array<struct<first, last>> (last is exclusive): windows that step by limit - overlap, the last flush with the end; of
    more than ``cap``, that many evenly spaced ones with both ends."""
    step = limit - overlap
    more = F.ceil((n - limit) / step).cast("int")
    starts = F.when(n <= limit, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), more), lambda i: F.least(i * step, n - limit).cast("int")))
    few = F.when(F.size(starts) <= cap, starts).otherwise(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.get(starts, F.bround(i * (F.size(starts) - 1) / F.lit(float(cap - 1))).cast("int"))))
    return F.transform(few, lambda s: F.struct(s.alias("first"), F.least(s + limit, n).cast("int").alias("last")))


def covered(windows: Column) -> Column:
    """Positions in the union of windows ordered by start."""
    return F.aggregate(windows, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, w: F.struct((a["n"] + F.greatest(w["last"] - F.greatest(w["first"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], w["last"]).alias("end")), lambda a: a["n"])


# The vocabulary of lines that close a comment card.
AGE_UNITS = ("分钟前", "小时前", "天前", "周前", "个月前")
AGE_UNITS_EN = ("m", "h", "d", "minute", "minutes", "hour", "hours", "day", "days")
DAY_WORDS = ("刚刚", "昨天", "今天", "前天")
REPLY_WORDS = ("回复", "reply", "translate")
ACTION_WORDS = ("回复", "翻译", "赞")


def _one_of(x: Column, words: tuple) -> Column:
    return x.isin(*words)


def _is_date(x: Column) -> Column:
    """Whether x is month and day, or year, month and day."""
    parts = F.split(x, "[-/]")
    sizes = F.transform(parts, lambda p: F.length(p))
    day = lambda n: n.between(1, 2)
    return ((F.size(parts) == 2) & F.forall(sizes, day)) | ((F.size(parts) == 3) & (F.get(sizes, F.lit(0)) == 4) & F.forall(F.slice(sizes, 2, 2), day))


def is_card_end(text: Column) -> Column:
    """Whether a line closes a comment card: a date with nothing or a reply link behind it, an age, a day word, or the links
    under a comment (like, reply, translate, view replies). Lines are read in lower case with single spaces."""
    value = F.lower(clean_text(text))
    words = F.split(value, " ")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    # The leading number, or date, and what follows it.
    date, number = F.regexp_extract(value, "^[0-9/-]+", 0), F.regexp_extract(value, "^[0-9]+", 0)
    after_date, after_number = F.substring(value, F.length(date) + 1, F.length(value)), F.ltrim(F.substring(value, F.length(number) + 1, F.length(value)))
    open_end = lambda x: (x == "") | F.startswith(x, F.lit(" "))
    reply_behind = reduce(lambda a, b: a | b, [F.contains(after_date, F.lit(w)) for w in REPLY_WORDS])
    dated = _is_date(date) & (open_end(after_date) | reply_behind)
    unit = F.split(after_number, " ")
    aged = (number != "") & (_one_of(F.get(unit, F.lit(0)), AGE_UNITS) | (_one_of(F.get(unit, F.lit(0)), AGE_UNITS_EN) & F.coalesce(F.get(unit, F.lit(1)).rlike(r"^ago\b"), F.lit(False))))
    # Links of one line, after a count of likes.
    links = F.when(F.startswith(value, F.lit("like")), F.ltrim(F.regexp_replace(F.ltrim(F.substring(value, 5, 1_000_000)), "^[0-9]+", ""))).otherwise(value)
    linked = _one_of(F.split(links, " ")[0], REPLY_WORDS[1:]) & ((F.size(F.split(links, " ")) == 1) | (F.size(F.split(links, " ")) == 2) & (F.get(F.split(links, " "), F.lit(1)) == "translate"))
    counted = _one_of(word(0), ACTION_WORDS) & ((F.size(words) == 1) | (F.size(words) == 2) & word(1).rlike("^[0-9]+$"))
    # The first vowels of "view" are often read wrongly by OCR.
    viewed = _one_of(word(0), ("view", "viow")) & word(1).rlike("^[0-9]+$") & F.startswith(word(2), F.lit("repl"))
    inner = F.replace(F.substring(value, 3, F.greatest(F.length(value) - 4, F.lit(0))), F.lit(" "), F.lit(""))
    unfolded = F.startswith(value, F.lit("展开")) & F.endswith(value, F.lit("回复")) & inner.rlike("^[0-9]*条?$")
    return F.coalesce(reduce(lambda a, b: a | b, [dated, aged, _one_of(word(0), DAY_WORDS), linked, counted, viewed, unfolded]), F.lit(False))


def input_limits(text: Column, comments: Column, image_sizes: Column, file_bytes: Column | None = None, least: int = 20, longest: int = 10_000, most: int = 30, images: int = 2, image_total: int = 2 * 1024 * 1024, file_limit: int = 100_000) -> Column:
    """array<string>: the limits that an input breaks. Text is counted in code points; an uploaded text file has to be UTF-8."""
    n = F.length(F.coalesce(text, F.lit("")))
    total = F.aggregate(F.coalesce(image_sizes, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    checks = [(n < least, "text_too_short"), (n > longest, "text_too_long"), (F.size(F.coalesce(comments, F.array().cast("array<string>"))) > most, "too_many_comments"), (F.size(F.coalesce(image_sizes, F.array().cast("array<bigint>"))) > images, "too_many_images"), (total > image_total, "images_too_large")]
    if file_bytes is not None:
        checks += [(F.octet_length(file_bytes) > file_limit, "file_too_large"), (file_bytes.isNotNull() & ~F.is_valid_utf8(file_bytes.cast("string")), "file_not_utf8")]
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for when, name in checks]))


#: What an image of a request may start with.
IMAGE_PREFIXES = ("data:image/png;base64,", "data:image/jpeg;base64,", "data:image/webp;base64,", "upload_")


def request_errors(text: Column, comments: Column, images: list[Column], longest: int = 10_000, most: int = 30) -> Column:
    """array<string>: the fields that break the request's schema."""
    allowed = lambda x: reduce(lambda a, b: a | b, [F.startswith(x, F.lit(p)) for p in IMAGE_PREFIXES])
    checks = [(text.isNull(), "text is missing"), (F.length(text) > longest, "text is too long"), (F.size(comments) > most, "too many comments"), *[(x.isNotNull() & ~allowed(x), f"image {i} is not supported") for i, x in enumerate(images)]]
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for when, name in checks]))


def fit_windows(windows: Column, decode: Callable[[list[int]], str], encode: Callable[[str], list[int]], most: int) -> Column:
    """array<struct<start, text, size>> from array<struct<start, ids>>: each window cut at its end until its decoded text
    encodes to at most ``most`` tokens; an error if none does. The tokenizer is the caller's."""

    @F.pandas_udf("array<struct<start:int,text:string,size:int>>")
    def run(rows: pd.Series) -> pd.Series:
        def fit(window):
            ids = list(window["ids"])
            for size in range(len(ids), 0, -1):
                text = decode(ids[:size])
                if text.strip() and len(encode(text)) <= most:
                    return {"start": window["start"], "text": text, "size": size}
            raise ValueError(f"no part of the window at {window['start']} can be encoded")

        return pd.Series([None if r is None else [fit(w) for w in r] for r in rows], dtype=object)

    return run(windows)


def best_window(scores: Column) -> Column:
    """The place of the largest score, the first on ties; null for none."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1)
