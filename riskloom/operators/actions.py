"""User actions as validated batches: requests x current state -> accepted and rejected rows with a reason.

Requests: request_id, action, vendor_id, event_id, alert_id, status, company_number, criticality, owner, note, actor,
requested_at. State is the fold of what was accepted; nothing is updated in place. Within one batch requests count in
the order (requested_at, request_id).
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import fixed
from riskloom.functions.normalize import company_number_input, strip
from riskloom.operators.spread import at_rest

ALERT_ID_HEX = 16  # eight hex digits would collide from some ten thousand alerts on

ORDER = ("requested_at", "request_id")


def _order() -> Column:
    return F.struct(*ORDER)


def _blank(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit(""))) == ""


def _exists(requests: DataFrame, known: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds a boolean column: is the key known? Keys of `known` are unique or made so."""
    there = known.select(key).distinct().withColumn(flag, F.lit(True))
    return requests.join(there, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _judged(df: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """Column `reason`: message of the first rule that fails, null when all hold."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), why) for ok, why in rules])
    return df.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def _said(text: str, *values: Column) -> Column:
    """A rejection's text; a value that is missing reads None."""
    return F.format_string(fixed.REJECTIONS[text], *[F.coalesce(v.cast("string"), F.lit("None")) for v in values])


def _unknown_vendor() -> Column:
    return _said("vendor", F.col("vendor_id"))


# ---- alerts --------------------------------------------------------------------------------------------------

def alert_id(request_id: Column) -> Column:
    """Same request, same alert: a replayed batch creates nothing new."""
    return F.concat(F.lit("ALT-"), F.upper(F.substring(F.md5(request_id.cast("string")), 1, ALERT_ID_HEX)))


def raise_alert(requests: DataFrame, suppliers: DataFrame, events: DataFrame, alerts: DataFrame,
                closings: DataFrame | None = None) -> DataFrame:
    """Every raise_alert request with accepted, reason and alert_id.

    Rules in order: supplier known, event known, owner given, no alert that is not closed for (supplier, event) when
    the request comes - neither from before the batch nor from an earlier valid request in it.
    closings: alert_id, requested_at, request_id of the moves in this batch that closed an alert.
    """
    r = requests.filter(F.col("action") == "raise_alert").drop("alert_id")
    r = _exists(_exists(r, suppliers, "vendor_id", "_v"), events, "event_id", "_e")
    pair = ["vendor_id", "event_id"]
    live = alerts.filter(F.col("status") != "closed").select(*pair, "alert_id")
    never = F.lit(True)
    if closings is not None:
        ended = closings.select("alert_id", F.struct(*ORDER).alias("_end"))
        live, never = live.join(ended, "alert_id", "left"), F.col("_end").isNull()
        last = F.when(F.count_if(never) == 0, F.max("_end"))
    else:
        last = F.lit(None).cast("struct<requested_at:timestamp,request_id:string>")
    live = live.groupBy(*pair).agg(F.coalesce(F.min(F.when(never, F.col("alert_id"))), F.min("alert_id"))
                                   .alias("_open"), last.alias("_free_from"))
    r = r.join(live, pair, "left")
    # Closed by then: the pair is free again.
    if closings is not None:
        r = r.withColumn("_open", F.when(~F.coalesce(_order() > F.col("_free_from"), F.lit(False)), F.col("_open")))
    r = r.drop("_free_from")
    valid = F.col("_v") & F.col("_e") & ~_blank("owner") & F.col("_open").isNull()
    # First valid request per pair: an aggregate, so a pair with very many requests is combined before the shuffle.
    first = (r.filter(valid).groupBy(*pair).agg(F.min(_order()).alias("_first"))
             .select(*pair, F.col("_first.request_id").alias("_first_id")))
    r = r.join(first, pair, "left")
    own = F.col("_first_id") == F.col("request_id")
    blocking = F.coalesce(F.col("_open"), alert_id(F.col("_first_id")))
    r = _judged(
        r, (F.col("_v"), _unknown_vendor()),
        (F.col("_e"), _said("event", F.col("event_id"))), (~_blank("owner"), _said("owner")),
        (F.col("_open").isNull() & own, _said("open", blocking)))
    return r.withColumn("alert_id", F.when(F.col("accepted"), alert_id(F.col("request_id")))).drop(
        "_v", "_e", "_open", "_first_id")


def new_alerts(judged: DataFrame) -> DataFrame:
    """Rows for the alert table from accepted raise_alert requests."""
    return judged.filter("accepted").select(
        "alert_id", "vendor_id", "event_id", F.lit("open").alias("status"), strip(F.col("owner")).alias("owner"),
        F.coalesce("note", F.lit("")).alias("note"), F.col("requested_at").alias("created_at"),
        F.col("requested_at").alias("updated_at"), F.col("request_id").cast("string").alias("raised_by"))


def _may_move(current: Column, to: Column) -> Column:
    return reduce(lambda a, b: a | b, [(current == frm) & to.isin(list(tos))
                                       for frm, tos in fixed.ALERT_TRANSITIONS.items() if tos])


def _allowed(current: Column) -> Column:
    out = F.lit(fixed.REJECTIONS["no_move"])
    for frm, tos in fixed.ALERT_TRANSITIONS.items():
        if tos:
            out = F.when(current == frm, F.lit(", ".join(sorted(tos)))).otherwise(out)
    return out


def longest_chain(moves: Mapping[str, Sequence[str]]) -> int:
    """How often an alert can move at most: the longest path through the table of legal moves."""
    def from_(status: str, seen: tuple[str, ...]) -> int:
        if status in seen:
            raise ValueError(f"statuses must not return: {status}")
        return max((1 + from_(to, (*seen, status)) for to in moves.get(status, ())), default=0)

    return max((from_(s, ()) for s in moves), default=0)


LONGEST_CHAIN = longest_chain(fixed.ALERT_TRANSITIONS)


def update_alert_status(requests: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judged requests, alerts after the batch).

    The batch is folded in as many rounds as an alert can move (a status never returns). Each round finds, per alert,
    the first request after its last move that is legal from its status - an aggregate with map-side combine, however
    many requests one alert has. A request is then judged by the status the alert had when it came; one that came
    before the alert was created knows no alert.
    """
    r = requests.filter(F.col("action") == "update_alert_status").select(
        "request_id", "alert_id", F.col("status").alias("to"), "note", "actor", "requested_at")
    at_type = dict(requests.dtypes)["requested_at"]
    closing_ok = (F.col("to") != "closed") | ~_blank("note")
    raised_by = F.col("raised_by") if "raised_by" in alerts.columns else F.lit("")
    born = F.struct(F.col("created_at").cast(at_type).alias("requested_at"), raised_by.alias("request_id"))
    state = alerts.select("alert_id", F.col("status").alias("from"), born.alias("at"))
    r = r.withColumn("request_id", F.col("request_id").cast("string"))
    moves = []
    for n in range(LONGEST_CHAIN):
        later = _order() > F.col("at")
        move = (r.join(state, "alert_id").filter(later & _may_move(F.col("from"), F.col("to")) & closing_ok)
                .groupBy("alert_id").agg(F.min_by(F.struct("from", "to", "note", "actor", *ORDER), _order())
                                         .alias("m")))
        moves.append(move)
        # Alerts without a legal request are done: only the moved ones go on.
        state = move.select("alert_id", F.col("m.to").alias("from"),
                            F.struct(F.col("m.requested_at"), F.col("m.request_id")).alias("at"))

    base = alerts.select("alert_id", F.col("status").alias("s0"), born.alias("born"))
    for n, move in enumerate(moves, 1):
        base = base.join(move.withColumnRenamed("m", f"m{n}"), "alert_id", "left")

    judged = r.join(base, "alert_id", "left")
    # Status when the request came: that of the last move before it.
    known = F.coalesce(_order() > F.col("born"), F.lit(False))
    current = F.when(known, F.col("s0"))
    for n in range(1, LONGEST_CHAIN + 1):
        m = F.col(f"m{n}")
        before = m.isNotNull() & (_order() > F.struct(m["requested_at"], m["request_id"]))
        current = F.when(before, m["to"]).otherwise(current)
    judged = judged.withColumn("from", current)
    judged = _judged(
        judged, (known, _said("alert", F.col("alert_id"))),
        (_may_move(F.col("from"), F.col("to")), _said("move", F.col("from"), F.col("to"), _allowed(F.col("from")))),
        (closing_ok, _said("closing")))
    judged = judged.select("request_id", "alert_id", "from", "to", "note", "actor", "requested_at", "accepted",
                           "reason")

    def line(m: Column) -> Column:
        return F.concat(F.lit("["), F.date_format(m["requested_at"], "dd MMM HH:mm"), F.lit(" "), m["actor"],
                        F.lit("] "), m["to"], F.lit(": "), F.coalesce(m["note"], F.lit("None")))

    ms = [F.col(f"m{n}") for n in range(1, LONGEST_CHAIN + 1)]
    status = F.coalesce(*[m["to"] for m in reversed(ms)], F.col("status"))
    updated = F.coalesce(*[m["requested_at"] for m in reversed(ms)], F.col("updated_at"))
    note = F.nullif(F.concat_ws("\n", F.nullif("note", F.lit("")), *[F.when(m.isNotNull(), line(m)) for m in ms]),
                    F.lit(""))
    after = alerts.join(base.drop("s0", "born"), "alert_id", "left").select(
        "alert_id", "vendor_id", "event_id", status.alias("status"), "owner",
        F.coalesce(note, F.col("note")).alias("note"), "created_at", updated.alias("updated_at"))
    return judged, after


# ---- decisions about suppliers -------------------------------------------------------------------------------

def confirm_match(requests: DataFrame, suppliers: DataFrame, companies: DataFrame) -> DataFrame:
    """The number may be that of any registered company, also one no supplier touched so far."""
    r = requests.filter(F.col("action") == "confirm_match").withColumn(
        "company_number", company_number_input(F.col("company_number")))
    r = _exists(_exists(r, suppliers, "vendor_id", "_v"), companies, "company_number", "_c")
    r = _judged(r, (F.col("_v"), _unknown_vendor()),
                (F.col("_c"), _said("company", F.col("company_number"))))
    return r.drop("_v", "_c")


def reject_match(requests: DataFrame, suppliers: DataFrame) -> DataFrame:
    r = requests.filter(F.col("action") == "reject_match").withColumn("company_number", F.lit(None).cast("string"))
    return _judged(_exists(r, suppliers, "vendor_id", "_v"), (F.col("_v"), _unknown_vendor())).drop("_v")


def set_criticality(requests: DataFrame, suppliers: DataFrame) -> DataFrame:
    r = requests.filter(F.col("action") == "set_criticality")
    levels = sorted(fixed.CRITICALITY_WEIGHT)
    return _judged(_exists(r, suppliers, "vendor_id", "_v"), (F.col("_v"), _unknown_vendor()),
                   (F.col("criticality").isin(levels), _said("criticality", F.lit(", ".join(levels))))).drop("_v")


def latest_wins(decisions: DataFrame, key: str, at: str = "requested_at", seq: str = "request_id") -> DataFrame:
    """Upsert by key: the last decision stands. An aggregate, so no key is sorted in one task."""
    rest = [c for c in decisions.columns if c != key]
    return (decisions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, seq)).alias("d"))
            .select(key, "d.*"))


def match_overrides(confirmed: DataFrame, rejected: DataFrame) -> DataFrame:
    """The match_override table after a batch: last of confirm and reject per supplier."""
    def side(df: DataFrame, decision: str) -> DataFrame:
        return df.filter("accepted").select("vendor_id", "company_number", F.lit(decision).alias("decision"),
                                            F.col("actor").alias("decided_by"),
                                            F.col("requested_at").alias("decided_at"), "request_id")

    return latest_wins(side(confirmed, "confirm").unionByName(side(rejected, "reject")), "vendor_id", "decided_at")


def criticality_overrides(judged: DataFrame) -> DataFrame:
    return latest_wins(judged.filter("accepted").select(
        "vendor_id", "criticality", F.col("actor").alias("decided_by"), F.col("requested_at").alias("decided_at"),
        "request_id"), "vendor_id", "decided_at")


# ---- log -----------------------------------------------------------------------------------------------------

# The parameters each action writes to the log, in order.
LOGGED = {
    "raise_alert": ("alert_id", "vendor_id", "event_id", "owner", "note"),
    "update_alert_status": ("alert_id", "from", "to", "note"),
    "confirm_match": ("vendor_id", "company_number"),
    "reject_match": ("vendor_id",),
    "set_criticality": ("vendor_id", "criticality"),
}


def action_log(judged: dict[str, DataFrame]) -> DataFrame:
    """(request_id, action, params, actor, logged_at) of the accepted requests; params as JSON."""
    parts = [df.filter("accepted").select(
        F.col("request_id").cast("string").alias("request_id"), F.lit(action).alias("action"),
        F.to_json(F.struct(*LOGGED[action]), {"ignoreNullFields": "false"})
        .alias("params"), "actor", F.col("requested_at").alias("logged_at"))
        for action, df in judged.items()]
    return reduce(DataFrame.unionByName, parts)


def _closings(moved: DataFrame) -> DataFrame:
    return moved.filter(F.col("accepted") & (F.col("to") == "closed")).select("alert_id", *ORDER)


def judge_all(requests: DataFrame, suppliers: DataFrame, events: DataFrame, companies: DataFrame,
              alerts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every request of a batch against current state: (judged per action, alert table after the batch).

    Raises and status changes of a (supplier, event) count in time order: an alert that a change closes frees its pair
    for a later raise, and a change knows an alert from its raise on. An alert raised in this batch can be closed in
    it and raised again; such rounds go on while a pair that was freed has later raises, and each one judges only
    those. Requests are compared by (requested_at, request_id).
    """
    cols = ["alert_id", "vendor_id", "event_id", "status", "owner", "note", "created_at", "updated_at"]
    changes = requests.filter(F.col("action") == "update_alert_status")
    moved, after = update_alert_status(changes, alerts.select(*cols))
    moved = at_rest(moved, "moved")  # read by the raises, by the next rounds and by the caller
    raised = at_rest(raise_alert(requests, suppliers, events, alerts, _closings(moved)), "raised")
    new = new_alerts(raised)

    def change_new() -> tuple[DataFrame, DataFrame]:
        """Changes that name an alert of this batch, and the alerts after them."""
        of_new = changes.join(new.select("alert_id"), "alert_id", "left_semi")
        judged, state = update_alert_status(of_new, new)
        return at_rest(judged, "moved"), state

    moved_new, after_new = change_new()
    all_raised, all_moved, all_after = raised, moved_new, after_new
    closed = _closings(moved_new)
    while not closed.isEmpty():
        # Raises that only the alert closed just now stood against.
        ends = new.join(closed.select("alert_id", F.struct(*ORDER).alias("_end")), "alert_id").select(
            "vendor_id", "event_id", "_end")
        pair = ["vendor_id", "event_id"]
        again = requests.filter(F.col("action") == "raise_alert").join(ends, pair).filter(
            _order() > F.col("_end")).drop("_end")
        if again.isEmpty():
            break
        raised = at_rest(raise_alert(again, suppliers, events, alerts.limit(0)), "raised")
        new = new_alerts(raised)
        moved_new, after_new = change_new()
        closed = _closings(moved_new)
        all_raised = all_raised.join(again.select("request_id"), "request_id", "left_anti").unionByName(
            raised.select(*all_raised.columns))
        all_moved, all_after = all_moved.unionByName(moved_new), all_after.unionByName(after_new)
    moved = moved.join(all_moved.select("request_id"), "request_id", "left_anti").unionByName(
        all_moved.select(*moved.columns))
    return {
        "raise_alert": all_raised,
        "update_alert_status": moved,
        "confirm_match": confirm_match(requests, suppliers, companies),
        "reject_match": reject_match(requests, suppliers),
        "set_criticality": set_criticality(requests, suppliers),
    }, after.select(*cols).unionByName(all_after.select(*cols))
