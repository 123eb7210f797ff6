"""Registered queries about places."""

from pyspark.sql import functions as F

from lontar.operators.spatial import neighbour_counts, regions_containing, within_radius
from lontar.runtime import table

#: How near listings are neighbours.
NEAR_KM = 0.05
#: A degree of latitude, for the boxes around places.
DEGREE_KM = 111.0


def p6_found(spark, folder):
    """Each listing and gazetteer place whose radius covers it."""
    return within_radius(table(spark, folder, "listings"), table(spark, folder, "gazetteer"), lat="koordinat_lat", lng="koordinat_lng")


def p6_near(spark, folder):
    """For each located listing the number of others within fifty metres."""
    return neighbour_counts(table(spark, folder, "listings"), NEAR_KM, lat="koordinat_lat", lng="koordinat_lng")


def p6_regions(spark, folder):
    """Each listing and the boxes around gazetteer places, as wide as their radius in degrees of latitude, that hold it."""
    places = table(spark, folder, "gazetteer").where("abs(lat) <= 90 and lng is not null and radius_km > 0")
    d = F.col("radius_km") / DEGREE_KM
    corner = lambda y, x: F.struct((F.col("lat") + y * d).alias("lat"), (F.col("lng") + x * d).alias("lng"))
    boxes = places.select("name", F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1)).alias("ring"))
    return regions_containing(table(spark, folder, "listings"), boxes, lat="koordinat_lat", lng="koordinat_lng")


QUERIES = {"p6_found": p6_found, "p6_near": p6_near, "p6_regions": p6_regions}

ORACLE = {
    "p6_found": """
        with spots as (select distinct id, koordinat_lat as lat, koordinat_lng as lng from listings
                       where abs(koordinat_lat) <= 90 and koordinat_lng is not null)
        select distinct s.id, g.name from spots s join gazetteer g on abs(g.lat) <= 90 and g.lng is not null
          and 2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians(g.lat - s.lat) / 2), 2)
            + cos(radians(s.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lng - s.lng) / 2), 2)))) <= g.radius_km""",
    "p6_near": """
        with spots as (select distinct id, koordinat_lat as lat, koordinat_lng as lng from listings
                       where abs(koordinat_lat) <= 90 and koordinat_lng is not null),
             near as (select a.id, a.lat, a.lng, count(*) - 1 as n from spots a join spots b on abs(a.lat - b.lat) <= 0.001e0
                        and 2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
                          + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 0.05e0
                      group by a.id, a.lat, a.lng)
        select id, max(n) as n_near from near group by id""",
    "p6_regions": """
        with spots as (select distinct id, koordinat_lat as lat, koordinat_lng as lng from listings
                       where abs(koordinat_lat) <= 90 and koordinat_lng is not null),
             boxes as (select name, lat - radius_km / 111e0 as s, lat + radius_km / 111e0 as n, lng - radius_km / 111e0 as w, lng + radius_km / 111e0 as e
                       from gazetteer where abs(lat) <= 90 and lng is not null and radius_km > 0)
        select distinct id, name from spots join boxes on lat >= s and lat < n and lng >= w and lng < e""",
}
