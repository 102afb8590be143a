"""basketry: basket reorder analytics as Spark DataFrame jobs.

Layout
------
sources/    basket table schemas, readers, the fixture adapter, the
            table provider (lazy or materialised) and the CSV sink
functions/  column-level building blocks (metrics, summaries, id lists)
operators/  DataFrame -> DataFrame operators: dimensions, profiles,
            features, splits, baselines, evaluation, submissions, model
plans/      the query catalogue (name -> Spark job) and its SQL twins
streaming/  micro-batch scoring of arriving target orders
"""

from basketry.session import build_session, tune_session

__all__ = ["build_session", "tune_session"]
