"""JSON that breaks off, as answers of a limited length do: closed by one fold over its characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"(?:^|[\s,:\[])(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"


def closed_json(text: Column) -> Column:
    """The text from its first bracket on, made complete: open strings are ended (a broken escape goes), open brackets closed,
    and what is no whole member or element yet is left out. Text after the first complete document is left out, and so is all
    from the first place on where it is no JSON. Null where there is no bracket at all.

    The fold keeps its place, what it expects, the open brackets, and the last place at which they could all be closed.
    """
    body = F.regexp_extract(text, r"(?s)[\[{].*", 0)

    def expects(s, *modes) -> Column:
        return s["mode"].isin(*modes)

    # modes: v value, V value or ], K key or }, k key, q in a key, c colon, s in a string, t in a number or word, e after a
    # value, x broken
    zero = F.struct(F.lit(0).alias("at"), F.lit("v").alias("mode"), F.lit("").alias("open"), F.lit(0).alias("escape"), F.lit(0).alias("escape_at"), F.lit(0).alias("safe"), F.lit("").alias("safe_open"))

    def step(s, c):
        word = c.rlike(r"^[0-9A-Za-z+.\-]$")
        ended = expects(s, "t") & ~word
        mode = F.when(ended, "e").otherwise(s["mode"])
        top, shut = F.right(s["open"], F.lit(1)), F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)
        blank, quoted = c.rlike(r"^\s$"), mode.isin("q", "s")
        opens = mode.isin("v", "V") & c.isin("{", "[")
        closes = (mode.isin("e", "V") & (c == "]") & (top == "[")) | (mode.isin("e", "K") & (c == "}") & (top == "{"))
        plain_quote = (c == '"') & (s["escape"] == 0)
        after = (
            F.when(quoted & ~plain_quote, mode)
            .when(quoted, F.when(mode == "q", "c").otherwise("e"))
            .when(mode == "t", "t")
            .when(blank, mode)
            .when(opens, F.when(c == "{", "K").otherwise("V"))
            .when(closes, "e")
            .when(mode.isin("v", "V") & (c == '"'), "s")
            .when(mode.isin("v", "V") & word, "t")
            .when(mode.isin("K", "k") & (c == '"'), "q")
            .when((mode == "c") & (c == ":"), "v")
            .when((mode == "e") & (c == ",") & (top == "["), "v")
            .when((mode == "e") & (c == ",") & (top == "{"), "k")
            .otherwise("x")
        )
        open_ = F.when(opens, F.concat(s["open"], c)).when(closes, shut).otherwise(s["open"])
        escape = F.when(~quoted, 0).when(s["escape"] == 0, F.when(c == "\\", 1).otherwise(0)).when(s["escape"] == 1, F.when(c == "u", 5).otherwise(0)).when(s["escape"] == 2, 0).otherwise(s["escape"] - 1)
        whole = opens | closes | (quoted & plain_quote & (mode == "s"))
        return F.struct(
            (s["at"] + 1).alias("at"), after.alias("mode"), open_.alias("open"), escape.alias("escape"),
            F.when(quoted & (s["escape"] == 0) & (c == "\\"), s["at"]).otherwise(s["escape_at"]).alias("escape_at"),
            F.when(whole, s["at"] + 1).when(ended, s["at"]).otherwise(s["safe"]).alias("safe"),
            F.when(whole, open_).when(ended, s["open"]).otherwise(s["safe_open"]).alias("safe_open"),
        )

    end = F.aggregate(F.split(body, ""), zero, step)

    def closers(open_: Column) -> Column:
        return F.translate(F.reverse(open_), "{[", "}]")

    def finished(s: Column) -> Column:
        whole_word = (s["mode"] == "t") & body.rlike(_TOKEN)
        ended = F.concat(F.when(s["escape"] > 0, F.left(body, s["escape_at"])).otherwise(body), F.lit('"'), closers(s["open"]))
        cut = F.when(s["safe"] > 0, F.concat(F.left(body, s["safe"]), closers(s["safe_open"])))
        return F.when(s["mode"] == "s", ended).when((s["mode"] == "e") | whole_word, F.concat(body, closers(s["open"]))).otherwise(cut)

    return F.when(body != "", F.get(F.transform(F.array(end), finished), F.lit(0)))


def read_json(text: Column) -> Column:
    """The closed text as a VARIANT; null where even that is no JSON."""
    return F.try_parse_json(closed_json(text))
