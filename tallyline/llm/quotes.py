"""Quotation linking: conversations rebuilt from what messages quote, in DataFrame functions alone.

A message's lines are parsed to quote levels: the number of leading ``>`` marks, blanks
between them allowed. Neighbouring lines of one level make a passage. A passage is
normalised (lower case, white space as single blanks, attribution lines such as "... wrote:"
left out) and hashed. A message's body is cut at line ends and after sentences, and every run of
neighbouring pieces is offered, however the quotation wraps its lines. As runs are many, none is hashed whole: running
sums of a rolling hash over the body's words give the hash of any stretch as a difference of two. A quotation is told by
its first and its last 2^k words, 2^k being at least half of it. These are joined with the stretches of that
many words that begin, and end, with a piece, so a body's rows are its pieces, not its runs. A quoted passage of level 1 is joined to
the latest earlier message that offers it, as of its position, deeper levels to the same by their own hashes;
the message linked at level 1 is the parent. A message without such a link answers the
message before it in its conversation, the first one starts a thread. Conversations are
given out in the order of their reply trees: a message, then its answers by position, each
followed by its own.

Defined results: null texts are empty; a null turn sorts first; repeated rows are
separate messages, placed by a hash of the text; passages shorter than ``least_chars``
after normalisation, an ideograph counting as three, link nothing; of several origins the latest earlier one of the same
conversation counts. A row with a null conversation is a conversation of its own. Quoted lines
are left out of the body. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import discard_frames, materialise, numbered

MARKS = r"^[ \t]*(>[> \t]*)"
#: A line that announces a quotation.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|le\b.*a écrit|am\b.*schrieb.*|el\b.*escribió)\s*:\s*$"
#: Scripts that are written without blanks.
DENSE = r"[\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef]"
DENSE_CHARS = 3


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(text: Column) -> Column:
    """Lower case, white space as single blanks, none beside ideographs, where it is only a line's end."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), f"(?<={DENSE}) | (?={DENSE})", "")


def _weight(text: Column) -> Column:
    return F.length(text) + (DENSE_CHARS - 1) * F.length(F.regexp_replace(text, DENSE.replace("[", "[^", 1), ""))


def _pieces(body: Column) -> Column:
    """Lines cut after their sentences, normalised."""
    cut = F.split(F.regexp_replace(F.regexp_replace(body, r"([.!?…])\s+", "$1\n"), "([。！？])", "$1\n"), "\n")
    return F.filter(F.transform(cut, normalised), lambda x: x != "")


#: An ideograph, or what blanks and ideographs part: texts are equal once normalised where these are.
TOKEN = DENSE + "|" + DENSE.replace("[", r"[^\s", 1) + "+"
#: Prime moduli and bases of the rolling hashes; products of two remainders fit a long.
MODULI, BASES = (2147483647, 2147483629), (1000003, 998244)


def _power(base: int, n: Column, p: int) -> Column:
    """base to the power of n, modulo p: a look-up for each byte of n."""
    out = F.lit(1).cast("long")
    for byte in range(4):
        table = F.expr(f"array({','.join(f'{pow(base, digit << 8 * byte, p)}L' for digit in range(256 if byte < 3 else 128))})")
        out = out * F.get(table, F.shiftright(n, 8 * byte).bitwiseAND(255)) % p
    return out


def _terms(token: Column, at: Column) -> dict[str, Column]:
    """What a token at a place adds to the rolling hashes."""
    return {f"h{i}": F.pmod(F.xxhash64(token, F.lit(i)), F.lit(p)) * _power(r, at, p) % p for i, (p, r) in enumerate(zip(MODULI, BASES, strict=True))}


def _wanted(cited: DataFrame) -> DataFrame:
    """(conv, hash, n, k, f0, f1, l0, l1) of distinct quotations: words, level, and hashes of the first and the last 2^k words."""
    held = cited.select("conv", "hash", "quote").dropDuplicates(["conv", "hash"]).select("conv", "hash", F.regexp_extract_all("quote", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    sized = held.withColumn("n", F.size("tokens")).withColumn("k", F.length(F.bin("n")) - 1)
    words = sized.select("conv", "hash", "n", "k", F.posexplode("tokens").alias("at", "token"))
    width = F.call_function("shiftleft", F.lit(1), F.col("k"))
    late = F.col("n") - width
    first = {f"f{i}": F.when(F.col("at") < width, c) for i, c in enumerate(_terms(F.col("token"), F.col("at")).values())}
    last = {f"l{i}": F.when(F.col("at") >= late, c) for i, c in enumerate(_terms(F.col("token"), F.greatest(F.col("at") - late, F.lit(0))).values())}
    summed = words.withColumns(first | last).groupBy("conv", "hash", "n", "k").agg(*[F.sum(c).alias(c) for c in (*first, *last)])
    return summed.withColumns({c: F.col(c) % MODULI[int(c[1])] for c in (*first, *last)})


def _offered(offers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv, hash, origin): which quotations are runs of pieces of which messages; offers: conv, origin, pieces."""
    levels = [r[0] for r in wanted.select("k").distinct().collect()] or [0]  # 31 at most
    by_piece = offers.select("conv", "origin", F.posexplode("pieces").alias("piece", "text")).withColumn("tokens", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    words = by_piece.select("conv", "origin", "piece", F.size("tokens").alias("n"), F.posexplode("tokens").alias("j", "token"))
    order = Window.partitionBy("conv", "origin").orderBy("piece", "j")
    placed = words.withColumn("t", F.row_number().over(order) - 1)
    placed = placed.withColumns(_terms(F.col("token"), F.col("t"))).withColumns({c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in ("h0", "h1")})
    bodies = placed.groupBy("conv", "origin").agg(F.sort_array(F.collect_list(F.struct("t", "h0", "h1", (F.col("j") == 0).alias("first"), (F.col("j") == F.col("n") - 1).alias("last")))).alias("words"))

    def stretches(side: str, begin) -> DataFrame:
        """Of every piece's side the stretches of 2^k words that begin at begin(word, 2^k): conv, origin, at, k, h0, h1."""

        def wide(word: Column, k: int) -> Column:
            at = begin(word, 1 << k)
            end, before = F.get("words", at + (1 << k) - 1), F.get("words", at - 1)
            return F.struct(at.alias("at"), F.lit(k).alias("k"), *[(end[h] - F.coalesce(before[h], F.lit(0))).alias(h) for h in ("h0", "h1")])

        every = F.flatten(F.transform(F.filter("words", lambda w: w[side]), lambda word: F.array(*[wide(word, k) for k in levels])))
        rows = bodies.select("conv", "origin", F.explode(F.filter(every, lambda x: (x["at"] >= 0) & x["h0"].isNotNull())).alias("x")).select("conv", "origin", "x.*")
        # Divided by the power of its place, a stretch hashes as it would at the beginning.
        return rows.withColumns({f"h{i}": F.col(f"h{i}") % p * _power(pow(r, -1, p), F.col("at"), p) % p for i, (p, r) in enumerate(zip(MODULI, BASES, strict=True))})

    starts = stretches("first", lambda word, width: word["t"]).withColumnsRenamed({"h0": "f0", "h1": "f1"})
    ends = stretches("last", lambda word, width: word["t"] - width + 1).withColumnsRenamed({"h0": "l0", "h1": "l1"})
    likely = starts.join(wanted, ["conv", "k", "f0", "f1"]).select("conv", "origin", "hash", "k", "l0", "l1", (F.col("at") + F.col("n") - F.call_function("shiftleft", F.lit(1), F.col("k"))).alias("at"))
    return likely.join(ends, ["conv", "origin", "at", "k", "l0", "l1"]).select("conv", "hash", "origin").distinct()


def _latest(cited: DataFrame, offered: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(conv, position, level, origin): of each citing message the latest earlier one that offers the passage; by blocks of positions, so that no task sorts all of a hash."""
    events = cited.select("conv", "hash", "position", "level", F.lit(None).cast("long").alias("origin")).unionByName(offered.select("conv", "hash", F.col("origin").alias("position"), F.lit(None).cast("int").alias("level"), "origin"))
    events = events.withColumn("block", F.expr(f"position div {block}"))
    within = Window.partitionBy("conv", "hash", "block").orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
    whole = events.groupBy("conv", "hash", "block").agg(F.max("origin").alias("most"))
    before = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.withColumn("earlier", F.max("most").over(before)).filter("earlier is not null").drop("most")
    own = events.withColumn("own", F.max("origin").over(within)).filter("level is not null")
    return own.join(earlier, ["conv", "hash", "block"], "left").withColumn("origin", F.coalesce("own", "earlier")).filter("origin is not null").groupBy("conv", "position", "level").agg(F.max("origin").alias("origin"))


def passages(text: Column) -> Column:
    """array<struct<level:int, text:string>>: neighbouring lines of one quote level, marks removed. Work grows with the lines."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("text")),
    )

    def grouped(lines: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
        texts = F.transform(lines, lambda x: x["text"])
        return _let(firsts, lambda at: _let(texts, lambda t: F.transform(at, lambda i, k: F.struct(F.get(lines, i)["level"].alias("level"), F.array_join(F.slice(t, i + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - i), "\n").alias("text")))))

    plain = F.array(F.struct(F.lit(0).alias("level"), F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n").alias("text")))
    return F.when(F.coalesce(text, F.lit("")).contains(">"), _let(lines, grouped)).otherwise(plain)


def _without_attribution(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(ATTRIBUTION)), "\n")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", least_chars: int = 12, most_in_a_row: int = 1000) -> DataFrame:
    """A row per message: conv, turn, role, position, parent (position of the answered message, null at a start),
    linked (by a quotation), quotes (passages), levels (deepest), sources (level, origin), depth (answers up to the
    start), place (in the walk of the reply tree), body.
    """
    raw = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = _positions(raw.filter("conv is not null")).unionByName(raw.filter("conv is null").withColumn("position", F.lit(0).cast("long")))
    parsed = placed.withColumn("passages", passages(F.col("text"))).withColumn("body", F.trim(_without_attribution(F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n"))))
    parsed = parsed.withColumns({"quotes": F.size(F.filter("passages", lambda p: p["level"] > 0)), "levels": F.array_max(F.transform("passages", lambda p: p["level"]))})
    parsed = materialise(parsed.select("conv", "turn", "role", "position", "passages", "body", "quotes", "levels"), "messages")
    cited = parsed.filter("quotes > 0 and conv is not null").select("conv", "position", F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p"))
    least_chars = max(1, least_chars)
    cited = cited.select("conv", "position", F.col("p.level").alias("level"), normalised(_without_attribution(F.col("p.text"))).alias("quote")).filter(_weight(F.col("quote")) >= least_chars)
    cited = materialise(cited.select("conv", "position", "level", F.sha2("quote", 256).alias("hash"), "quote").distinct(), "cited")
    # Only conversations in which something is quoted need to offer their pieces.
    offers = parsed.join(cited.select("conv").distinct(), "conv", "left_semi").select("conv", F.col("position").alias("origin"), _pieces(F.col("body")).alias("pieces")).filter("size(pieces) > 0")
    found = _latest(cited, _offered(offers, materialise(_wanted(cited), "wanted")))
    direct = found.groupBy("conv", "position").agg(F.max_by("origin", F.struct(-F.col("level"), "origin")).alias("origin"), F.sort_array(F.collect_list(F.struct("level", "origin"))).alias("sources"))
    answered = parsed.join(direct, ["conv", "position"], "left").withColumn("parent", F.coalesce("origin", F.when(F.col("position") > 0, F.col("position") - 1))).withColumn("linked", F.col("origin").isNotNull())
    answered = materialise(answered.select("conv", "turn", "role", "position", "parent", "linked", "quotes", "levels", "sources", "body"), "answers")
    return _walked(answered, most_in_a_row).withColumnsRenamed({"conv": conv, "turn": turn, "role": role})


def _positions(raw: DataFrame, most: int = 10_000) -> DataFrame:
    """Adds the message's number in its conversation, by turn, then by a hash of the text."""
    keyed = raw.withColumn("order", F.xxhash64("text", "role"))
    return numbered(keyed, "conv", [F.col("turn").asc_nulls_first(), F.col("order"), F.col("text")], most).drop("order")


def _walked(messages: DataFrame, most_in_a_row: int) -> DataFrame:
    """Adds depth and place, the message's number in a walk of its reply tree: parents before children, siblings by position.

    A conversation in which every message answers the one before it is walked in the order of positions. Of others the
    (position, parent) pairs are gathered in one row if there are at most ``most_in_a_row``; larger ones are
    walked by pointer jumping over all tasks.
    """
    alone = messages.filter("conv is null").withColumns({"depth": F.lit(0).cast("long"), "place": F.lit(0).cast("long")})
    shape = F.when(F.bool_and(F.coalesce(F.col("parent") == F.col("position") - 1, F.col("position") == 0)), "straight").when(F.count("*") <= most_in_a_row, "row").otherwise("jumps")
    shapes = materialise(messages.filter("conv is not null").groupBy("conv").agg(shape.alias("shape")).filter("shape <> 'straight'"), "shapes")
    pairs = messages.join(shapes, "conv").select("conv", "position", "parent", "shape")
    walks = _walk_in_rows(pairs.filter("shape = 'row'"))
    if shapes.filter("shape = 'jumps'").limit(1).count():
        walks = walks.unionByName(_walk_by_jumps(pairs.filter("shape = 'jumps'")))
    found = messages.filter("conv is not null").join(walks, ["conv", "position"], "left")
    return found.withColumns({c: F.coalesce(c, "position") for c in ("depth", "place")}).unionByName(alone)


def _walk_by_jumps(pairs: DataFrame) -> DataFrame:
    """(conv, position, depth, place): the tour that enters and leaves every message is a list, whose sums to its end double their reach in every round."""
    siblings = Window.partitionBy("conv", "parent").orderBy("position")
    after = pairs.withColumn("later", F.lead("position").over(siblings))
    child = pairs.filter("parent is not null").groupBy("conv", F.col("parent").alias("position")).agg(F.min("position").alias("child"))
    known = after.join(child, ["conv", "position"], "left")
    enter = F.struct((F.col("position") * 2).alias("at"), F.coalesce(F.col("child") * 2, F.col("position") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("places"), F.lit(1).cast("long").alias("depths"))
    leave = F.struct((F.col("position") * 2 + 1).alias("at"), F.coalesce(F.col("later") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("places"), F.lit(-1).cast("long").alias("depths"))
    tour = materialise(known.select("conv", F.explode(F.array(enter, leave)).alias("x")).select("conv", "x.*"), "tour")
    while tour.filter("next is not null").limit(1).count():
        ahead = tour.select("conv", F.col("at").alias("next"), F.col("next").alias("far"), F.col("places").alias("more"), F.col("depths").alias("deeper"))
        jumped = tour.join(ahead, ["conv", "next"], "left")
        before, tour = tour, materialise(jumped.select("conv", "at", F.col("far").alias("next"), (F.col("places") + F.coalesce("more", F.lit(0))).alias("places"), (F.col("depths") + F.coalesce("deeper", F.lit(0))).alias("depths")), "tour")
        discard_frames(before)
    entered = tour.filter("at % 2 = 0").select("conv", F.shiftright("at", 1).alias("position"), (-F.col("depths")).alias("depth"), "places")
    counts = pairs.groupBy("conv").agg(F.count("*").alias("n"))
    return entered.join(counts, "conv").select("conv", "position", "depth", (F.col("n") - F.col("places")).alias("place"))


def _walk_in_rows(pairs: DataFrame) -> DataFrame:
    """(conv, position, depth, place) of conversations of bounded size, each walked in one row.

    Parents come earlier, so one pass in order gives depth and path. Along first children a path
    only counts on, so it grows with branches, not with depth: 0 and the count for the message
    itself, before that 1, the count (negative, as deeper branches come first) and the position
    for each step to a later child.
    """
    earlier = F.lag("parent").over(Window.partitionBy("conv").orderBy("parent", "position"))
    marked = pairs.select("conv", F.col("position").cast("int").alias("position"), F.col("parent").cast("int").alias("parent"), (~F.coalesce(earlier == F.col("parent"), F.lit(False))).alias("first"))
    tree = marked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("position", "parent", "first"))).alias("tree"))
    none = F.array().cast("array<struct<path:array<int>,depth:int>>")

    def add(done: Column, m: Column) -> Column:
        above = F.get(done, m["parent"])
        count = F.element_at(above["path"], -1)
        stem = F.slice(above["path"], 1, F.size(above["path"]) - 2)
        onward = F.concat(stem, F.array(F.lit(0), count + 1))
        branch = F.concat(stem, F.array(F.lit(1), -count, m["position"], F.lit(0), F.lit(0)))
        path = F.when(m["parent"].isNull(), F.array(F.lit(0), F.lit(0))).when(m["first"], onward).otherwise(branch)
        return F.concat(done, F.array(F.struct(path.alias("path"), F.coalesce(above["depth"] + 1, F.lit(0)).alias("depth"))))

    walk = F.sort_array(F.transform(F.aggregate("tree", none, add), lambda x, i: F.struct(x["path"].alias("path"), i.alias("position"), x["depth"].alias("depth"))))
    places = tree.select("conv", F.posexplode(walk).alias("place", "m"))
    return places.select("conv", F.col("m.position").cast("long").alias("position"), F.col("m.depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"))


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", least_chars: int = 12) -> DataFrame:
    """link()'s rows, conversations one after another, each in the order of its reply tree; body is the text without quotations."""
    return link(messages, conv, turn, role, text, least_chars).orderBy(conv, "place")
