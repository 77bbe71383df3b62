"""What the steps of a plan gave out when it ran."""


def most_rows(df) -> int:
    """The largest number of rows that any step of the DataFrame's plan gives out."""
    df.collect()

    def walk(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        rows = plan.metrics().get("numOutputRows")
        children = plan.children()
        return max([rows.get().value() if rows.isDefined() else 0, *[walk(children.apply(i)) for i in range(children.size())]])

    return walk(df._jdf.queryExecution().executedPlan())
