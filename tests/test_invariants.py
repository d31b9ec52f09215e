"""The audit's invariants on the engine's own composed output."""

import os

import pytest
from pyspark.sql import functions as F

from geotrail.operators import audit, sequences
from geotrail.plans import found, groups
from geotrail.plans.registry import Inputs

from .oracles import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_mentions(spark):
    t = Inputs(spark, SF)
    mentions = found.built_mentions(t).cache()
    assert mentions.count() > 100
    assert audit.bad_slices(mentions.join(found.posts(t), "post_id")).count() == 0
    assert sequences.overlaps(mentions).count() == 0
    assert audit.not_unique(mentions, ["mention_id"]).count() == 0
    assert audit.dangling(mentions, "post_id", found.posts(t), "post_id").count() == 0
    # each kept term stands in its text more often than, or as often as, it was kept
    term = mentions.groupBy("post_id", "term").agg(F.count("*").alias("n")).join(found.posts(t), "post_id")
    assert all(r.content.count(r.term) >= r.n for r in term.collect())


def test_trips(spark):
    t = Inputs(spark, SF)
    trips = groups.built(t).cache()
    members = trips.select("trip_id", F.explode("visit_ids").alias("visit_id"))
    assert trips.count() > 10
    assert audit.misaligned(trips).count() == 0
    assert audit.bad_time_order(trips).count() == 0
    assert audit.shared_members(members, members.limit(0)).count() == 0
    assert audit.not_unique(trips, ["trip_id"]).count() == 0
    assert audit.dangling(members, "visit_id", t.fx_visits, "visit_id").count() == 0
