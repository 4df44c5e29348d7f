"""Notes, topics and short texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def ellipsized(text: Column, most: int) -> Column:
    """A text of more than `most` characters cut to that many, the last one an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 1)), F.lit("…")))


def censored(text: Column) -> Column:
    """The first character of each word, and a star for every other one (one at least)."""
    words = F.array_remove(F.split(text, r"\p{IsWhite_Space}+"), "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(w) - 1)))), " ")


def halves(text: Column, start: Column, end: Column) -> Column:
    """(first, second, at): a unit split at the blank nearest its middle (the earlier of two), or in the middle; null if a part would be empty.

    The time is split like the text, a blank between a tenth and nine tenths."""
    t = F.trim(text)
    n, mid = F.length(t), F.floor(F.length(t) / 2)
    # the last blank up to the middle and the first one after it, each found in one pass over its side
    back, ahead = F.instr(F.reverse(F.substring(t, F.lit(1), (mid + 1).cast("int"))), " "), F.instr(F.substring(t, (mid + 2).cast("int"), n), " ")
    low, high = F.when(back > 0, mid + 1 - back), F.when(ahead > 0, mid + ahead)
    at = F.when(high.isNull() | (mid - low <= high - mid), low).otherwise(high)
    first = F.when(at.isNotNull(), F.trim(F.substring(t, F.lit(1), at.cast("int")))).otherwise(F.substring(t, F.lit(1), mid.cast("int")))
    second = F.when(at.isNotNull(), F.trim(F.substring(t, (at + 2).cast("int"), n))).otherwise(F.substring(t, (mid + 1).cast("int"), n))
    share = F.when(at.isNotNull(), F.greatest(F.lit(0.1), F.least(F.lit(0.9), at / n))).otherwise(0.5)
    whole = (n >= 2) & (first != "") & (second != "")
    return F.when(whole, F.struct(first.alias("first"), second.alias("second"), (start + F.greatest(end - start, F.lit(0.1)) * share).alias("at")))


def harvest_note(confidence: Column, title: Column, at: Column) -> Column:
    """The provenance note of a harvested word; parse_note() reads it."""
    named = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(' from "'), title, F.lit('"'))).otherwise("")
    return F.concat(F.format_string("auto-harvested (conf %.2f)", confidence), named, F.lit(" at "), T.clock(at), F.lit(" - operator verify"))


def parse_note(note: Column) -> Column:
    """(confidence, title, at_s) of a provenance note, each null if it isn't there."""
    # all that follows the first mark: a title's last word makes another one with the quote behind it
    after = lambda mark: F.get(F.split(note, mark, 2), F.lit(1))
    confidence = F.trim(F.get(F.split(after("conf "), r"\)"), F.lit(0))).try_cast("float")
    title = F.get(F.split(after('from "'), '" at '), F.lit(0))
    trailer = " - operator verify"
    head = F.when(note.endswith(trailer), F.substring(note, F.lit(1), F.length(note) - len(trailer))).otherwise(F.get(F.split(note, trailer), F.lit(0)))
    tail = F.element_at(F.split(head, " at "), -1)
    whole = tail.rlike(r"^\s*\d+\s*:\s*\d+\s*(:\s*\d+\s*)?$") & (F.size(F.split(head, " at ")) > 1)
    return F.struct(confidence.alias("confidence"), F.when(title != "", title).alias("title"), F.when(whole, T.parse_clock(F.regexp_replace(tail, r"\s", ""))).alias("at_s"))


def topic(clip: Column, creator: Column, stream: Column) -> Column:
    """What a clip is about, for a prompt; a creator `local` is none."""
    said = lambda c, form: F.when(F.trim(c) != "", F.format_string(form, F.trim(c)))
    return F.concat_ws("; ", said(clip, 'clip "%s"'), F.when(F.trim(creator) != "local", said(creator, "streamer %s")), said(stream, 'stream "%s"'))


def is_todo(wrong: Column, right: Column) -> Column:
    return (wrong != "") & (right == "")


def parse_judgment(raw: Column, most: int = 10) -> Column:
    """(score, reason, title) of a judge's answer: its JSON object, else the number after a last `score`, else the first number, of 0 to `most`.

    Ordinals and denominators are no numbers; without any the score is 0."""
    obj = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    field = lambda k: F.get_json_object(obj, f"$.{k}")
    number = field("score").try_cast("double")
    low = F.lower(raw)
    # digits that aren't ordinals, nor after a slash or "out of"
    plain = r"(?<![0-9])(?<!/ {0,9})(?<!out of {0,9})([0-9]+)(?![0-9])(?!st|nd|rd|th)"
    pick = lambda t: F.get(F.filter(F.regexp_extract_all(t, F.lit(plain), 1), lambda x: x.try_cast("int") <= most), F.lit(0)).try_cast("double")
    tail = F.element_at(F.split(low, "score"), -1)
    labelled = F.when(low.contains("score") & tail.rlike(r"^[\s:=\"'*]*[0-9]"), pick(tail))
    score = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(number, labelled, pick(low), F.lit(0.0))))
    text = lambda k: F.when(number.isNotNull(), F.trim(F.coalesce(field(k), F.lit(""))))
    return F.struct(score.alias("score"), F.coalesce(text("reason"), F.trim(raw)).alias("reason"), F.coalesce(F.translate(text("title"), "–—", "--"), F.lit("")).alias("title"))


def probed(out: Column, key: str) -> Column:
    """The first value of a key in a probe's `key=value` lines, trimmed; null if it isn't there."""
    v = F.trim(F.regexp_extract(out, rf"(?m)^{key}=(.*)$", 1))
    return F.when(v != "", v)


def frame_rate(value: Column) -> Column:
    """A rate that is written as a fraction or a number; 0 if it isn't a positive one."""
    p = F.split(value, "/")
    n, d = (F.get(p, F.lit(i)).try_cast("double") for i in (0, 1))
    v = F.when(F.size(p) == 2, F.when(d > 0, n / d)).otherwise(value.try_cast("double"))
    return F.coalesce(F.when((v > 0) & (v < float("inf")), v), F.lit(0.0))


def video_probe(out: Column) -> Column:
    """(width, height, duration_s, start_time_s, fps) of a probe; null without a width or height, 0 for other values that can't be read."""
    number = lambda k: F.coalesce(probed(out, k).try_cast("double"), F.lit(0.0))
    w, h = probed(out, "width").try_cast("long"), probed(out, "height").try_cast("long")
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("width"), h.alias("height"), number("duration").alias("duration_s"), number("start_time").alias("start_time_s"), frame_rate(probed(out, "r_frame_rate")).alias("fps")))


def audio_probe(out: Column) -> Column:
    """(duration_s, sample_rate, channels) of a probe; null unless all are positive."""
    d, r, c = probed(out, "duration").try_cast("double"), probed(out, "sample_rate").try_cast("long"), probed(out, "channels").try_cast("long")
    return F.when((d > 0) & (d < float("inf")) & (r > 0) & (c > 0), F.struct(d.alias("duration_s"), r.alias("sample_rate"), c.alias("channels")))


def minutes(text: Column) -> Column:
    """m:ss.cc, or seconds alone, as seconds; null for anything else."""
    t = F.trim(text)
    at = F.instr(t, ":")
    whole = F.trim(F.substring(t, F.lit(1), at - 1)).try_cast("double") * 60 + F.trim(F.substring(t, at + 1, F.length(t))).try_cast("double")
    return F.when(at > 0, whole).otherwise(t.try_cast("double"))


# Seconds that a segment is padded by, and that it has to reach past a clip.
PAD, MARGIN = 2.0, 0.5


def padded(start: Column, end: Column, duration: Column) -> Column:
    """A range with PAD on both sides, inside [0, duration]; a null duration is no bound."""
    return F.struct(F.greatest(F.lit(0.0), start - PAD).alias("start_s"), F.least(end + PAD, F.coalesce(duration, F.lit(float("inf")))).alias("end_s"))


def tail_shortfall(anchor: Column, media: Column, end: Column) -> Column:
    """Seconds missing past a clip's end; 0 where the media's length isn't known."""
    return F.when(media > 0, F.greatest(F.lit(0.0), end + MARGIN - (anchor + media))).otherwise(0.0)


def class_label(line: Column) -> Column:
    """(index, name) of a line `index,mid,"name"` of a label file, in which names may hold commas; null for other lines."""
    index = F.trim(F.regexp_extract(line, r"^([^,]*),[^,]*,", 1)).try_cast("long")
    name = F.regexp_replace(F.trim(F.regexp_extract(line, r"^[^,]*,[^,]*,(.*?)\r?$", 1)), r'^"+|"+$', "")
    return F.when(index >= 0, F.struct(index.alias("index"), name.alias("name")))


def decision(line: Column) -> Column:
    """(at, word) of a line `n: word`: n counts from 1, at from 0; `DELETE` is a null word; null for lines that decide nothing."""
    t = F.trim(line)
    n = F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("long")
    token = F.regexp_extract(t, r"^[0-9]+[:.)\-\s]*(\S+)", 1)
    word = F.when(F.lower(token) != "delete", T.core(token))
    return F.when((n > 0) & (token != "") & (word.isNull() | (word != "")), F.struct((n - 1).alias("at"), word.alias("word")))


def clock_stem(seconds: Column) -> Column:
    """A clock for file names: m-ss, or h-mm-ss from an hour on."""
    return F.replace(T.clock(seconds), F.lit(":"), F.lit("-"))


def clip_id(start: Column) -> Column:
    """A clip's number: its start in whole milliseconds."""
    return F.round(F.greatest(start, F.lit(0.0)) * 1000).cast("long")
