"""Plans of workspaces from a log of operations: each operation is checked against the state that those before it left.

A valid ``set`` or ``clear`` leaves a state that depends on itself alone. So a workspace's log is cut at these into runs, and
each run is folded by itself, in order, as one native aggregate; what a run's first operation changes is told from
the end of the run before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ITEMS = "array<struct<id:string,text:string,status:string>>"
# The words of a plan's form.
STATUSES = ("pending", "in_progress", "completed")
ACTIONS = ("set", "update", "get", "clear")


def _fault(op: dict[str, Column]) -> Column:
    """What makes an operation invalid by itself; null for a valid one."""
    action, items, item, status = op["action"], op["items"], op["item"], op["status"]
    ids = F.transform(items, lambda x: x.id)
    set_ = (
        F.when(item.isNotNull() | status.isNotNull(), "set takes items only")
        .when(items.isNull() | (F.size(items) == 0), "set needs items")
        .when(F.exists(items, lambda x: F.coalesce(x.id, F.lit("")) == ""), "empty id")
        .when(F.exists(items, lambda x: F.coalesce(x.text, F.lit("")) == ""), "empty text")
        .when(F.exists(items, lambda x: ~F.coalesce(x.status.isin(*STATUSES), F.lit(False))), "unknown status")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated id")
        .when(F.size(F.filter(items, lambda x: x.status == "in_progress")) > 1, "two items in progress")
    )
    update = F.when(items.isNotNull(), "update takes no items").when(F.coalesce(item, F.lit("")) == "", "update needs an id").when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "update needs a status")
    other = F.when(items.isNotNull() | item.isNotNull() | status.isNotNull(), "takes the workspace only")
    return F.when(action == "set", set_).when(action == "update", update).when(action.isin("get", "clear"), other).otherwise("unknown action")


def _step(state: Column, op: Column) -> Column:
    """The state after one operation of a run: whether there is a plan, its items, and a row of outcome for each operation so far."""
    items = state["items"]
    found = F.get(F.filter(items, lambda x: x.id == op["item"]), F.lit(0))
    now = found["status"]
    allowed = ((now == "pending") & (op["status"] == "in_progress")) | ((now == "in_progress") & (op["status"] == "completed"))
    busy = F.exists(items, lambda x: (x.status == "in_progress") & (x.id != op["item"])) & (op["status"] == "in_progress")
    conflict = F.when(op["action"] == "update", F.when(~state["held"], "no plan").when(found.isNull(), "no such item").when(now == op["status"], None).when(~allowed, "no such step").when(busy, "another item in progress"))
    error = F.coalesce(op["fault"], conflict)
    moves = error.isNull() & (op["action"] == "update") & (now != op["status"])
    resets = error.isNull() & op["action"].isin("set", "clear")
    held = F.when(resets, op["action"] == "set").otherwise(state["held"])
    moved = F.transform(items, lambda x: F.when(x.id == op["item"], F.struct(x.id.alias("id"), x.text.alias("text"), op["status"].alias("status"))).otherwise(x))
    after = F.when(resets, F.coalesce(op["items"], F.array().cast(ITEMS))).when(moves, moved).otherwise(items)
    done = F.size(F.filter(after, lambda x: x.status == "completed"))
    kind = F.when(error.isNull(), "ok").when(op["fault"].isNotNull(), "invalid").otherwise("conflict")
    outcome = F.struct(op["seq"].alias("seq"), op["action"].alias("action"), kind.alias("outcome"), error.alias("error"), F.coalesce(moves, F.lit(False)).alias("changed"), done.alias("completed"), F.size(after).alias("total"))
    return F.struct(held.alias("held"), after.alias("items"), F.array_append(state["log"], outcome).alias("log"))


def _folded(operations: DataFrame) -> DataFrame:
    """workspace, run, first (the first operation of a run that begins with a valid one, else null), held, items, log."""
    trimmed = F.transform("items", lambda x: F.struct(F.trim(x.id).alias("id"), F.trim(x.text).alias("text"), x.status.alias("status")))
    rows = operations.where("workspace is not null").select("workspace", "seq", "action", F.when(F.col("action") == "set", trimmed).otherwise(F.col("items")).alias("items"), F.trim("item").alias("item"), "status")
    rows = rows.withColumn("fault", _fault({c: F.col(c) for c in ("action", "items", "item", "status")}))
    resets = F.col("fault").isNull() & F.col("action").isin("set", "clear")
    order = Window.partitionBy("workspace").orderBy("seq")
    rows = rows.withColumn("run", F.sum(resets.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    op = F.struct("seq", "action", "items", "item", "status", "fault")
    runs = rows.groupBy("workspace", "run").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    none = F.array().cast("array<struct<seq:bigint,action:string,outcome:string,error:string,changed:boolean,completed:int,total:int>>")
    start = F.struct(F.lit(False).alias("held"), F.array().cast(ITEMS).alias("items"), none.alias("log"))
    return runs.select("workspace", "run", F.when(F.col("run") > 0, F.col("ops")[0]).alias("first"), F.aggregate("ops", start, _step).alias("s")).select("workspace", "run", "first", "s.*")


def plan_outcomes(operations: DataFrame) -> DataFrame:
    """workspace, seq, action, outcome, error, changed, completed, total of each of ``operations`` (workspace, seq, action, items, item, status).

    ``items`` is an array of id, text, status. outcome is ``ok``, ``invalid`` (wrong by itself) or ``conflict`` (wrong in the state that it
    meets): an item goes from pending to in_progress to completed, and one at most is in progress. Faulty operations change nothing;
    seq tells the order and is not repeated within a workspace; null workspaces drop.
    """
    runs = _folded(operations)
    order = Window.partitionBy("workspace").orderBy("run")
    before = runs.withColumns({"_held": F.coalesce(F.lag("held").over(order), F.lit(False)), "_items": F.coalesce(F.lag("items").over(order), F.array().cast(ITEMS))})
    own = F.col("first")["items"]
    changes = F.when(F.col("first")["action"] == "clear", F.col("_held")).otherwise(~F.col("_held") | (own != F.col("_items")))
    told = before.select("workspace", changes.alias("_changes"), F.col("first")["seq"].alias("_seq"), F.inline("log"))
    return told.select("workspace", "seq", "action", "outcome", "error", F.when(F.col("seq") == F.col("_seq"), F.col("_changes")).otherwise(F.col("changed")).alias("changed"), "completed", "total")


def plan_items(operations: DataFrame) -> DataFrame:
    """workspace, pos, id, text, status of the plans that ``operations`` leave."""
    last = _folded(operations).groupBy("workspace").agg(F.max_by("items", "run").alias("items"))
    return last.select("workspace", F.posexplode("items").alias("pos", "_i")).select("workspace", "pos", "_i.*")
