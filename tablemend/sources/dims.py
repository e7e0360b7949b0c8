"""Small dimension tables with fixed content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT_VENDOR_ID = "00000000-0000-0000-0000-000000000000"
DEFAULT_ORIGIN = "MUM_HUB"
DEFAULT_DESTINATION = "DEL_HUB"

# Coordinates used to geo-enrich stored shipments.
GEO_HUBS = [
    ("MUM_HUB", 19.0760, 72.8777),
    ("DEL_HUB", 28.7041, 77.1025),
    ("BLR_HUB", 12.9716, 77.5946),
    ("HYD_HUB", 17.3850, 78.4867),
    ("MAA_HUB", 13.0827, 80.2707),
    ("ATLANTA", 33.7490, -84.3880),
    ("BOSTON", 42.3601, -71.0589),
    ("DALLAS", 32.7767, -96.7970),
    ("DENVER", 39.7392, -104.9903),
    ("MIAMI", 25.7617, -80.1918),
    ("SEATTLE", 47.6062, -122.3321),
    ("HOUSTON", 29.7604, -95.3698),
    ("CHICAGO", 41.8781, -87.6298),
    ("NEW YORK", 40.7128, -74.0060),
    ("LOS ANGELES", 34.0522, -118.2437),
    ("SIN_TERMINAL", 1.3521, 103.8198),
    ("LHR_HUB", 51.4700, -0.4543),
    ("JFK_TERMINAL", 40.6413, -73.7781),
    ("DXB_GATEWAY", 25.2532, 55.3657),
]

# Hubs of the route map, in list order.
MAP_HUBS = [
    ("h-01", "Seoul Incheon Hub", "ICN-HUB-01", 37.4602, 126.4407, "supplier", "South Korea"),
    ("h-02", "Shenzhen Port", "SZX-PORT-02", 22.5431, 113.9381, "supplier", "China"),
    ("h-03", "Munich Hub", "MUC-HUB-01", 48.3537, 11.7860, "supplier", "Germany"),
    ("h-04", "Mumbai Port", "BOM-PORT-01", 18.9388, 72.8354, "supplier", "India"),
    ("h-05", "Oslo Hub", "OSL-HUB-01", 59.9139, 10.7522, "supplier", "Norway"),
    ("h-06", "Jakarta Port", "CGK-PORT-01", -6.2146, 106.8451, "supplier", "Indonesia"),
    ("h-07", "Guangzhou Port", "CAN-PORT-01", 23.1291, 113.2644, "supplier", "China"),
    ("h-08", "Houston Distribution", "HOU-DIST-01", 29.7604, -95.3698, "distribution", "United States"),
    ("h-09", "Frankfurt Distribution", "FRA-DIST-03", 50.1109, 8.6821, "distribution", "Germany"),
    ("h-10", "Los Angeles Distribution", "LAX-DIST-01", 33.9425, -118.4081, "distribution", "United States"),
    ("h-11", "Detroit Factory", "DET-FACTORY-02", 42.3314, -83.0458, "factory", "United States"),
    ("h-12", "Rotterdam Distribution", "ROT-DIST-01", 51.9244, 4.4777, "distribution", "Netherlands"),
    ("h-13", "Hamburg Distribution", "HAM-DIST-02", 53.5753, 10.0153, "distribution", "Germany"),
    ("h-14", "Singapore Distribution", "SIN-DIST-03", 1.3521, 103.8198, "distribution", "Singapore"),
    ("h-15", "San Francisco Factory", "SFO-FACTORY-01", 37.6213, -122.3790, "factory", "United States"),
    ("h-16", "Chicago Factory", "CHI-FACTORY-03", 41.8781, -87.6298, "factory", "United States"),
]

# Vendor master rows.
VENDORS = [
    ("Hanaro Logistics KR", 1, "South Korea", "APAC", "ICN-HUB-01", 78.4),
    ("Shenzhen Premier Freight", 2, "China", "APAC", "SZX-PORT-02", 83.1),
    ("VDA AutoParts GmbH", 1, "Germany", "EMEA", "MUC-HUB-01", 96.2),
    ("Mumbai Precision Parts", 3, "India", "APAC", "BOM-PORT-01", 61.7),
    ("Nordic Supply AS", 2, "Norway", "EMEA", "OSL-HUB-01", 89.5),
    ("PT Nusantara Cargo", 3, "Indonesia", "APAC", "CGK-PORT-01", 74.8),
    ("Guangzhou TechLink", 2, "China", "APAC", "CAN-PORT-01", 81.3),
    ("Texas Industrial Supply", 2, "United States", "AMER", "HOU-DIST-01", 92.0),
]


def dim_geo_hubs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GEO_HUBS, "code string, lat double, lng double")


def dim_hubs(spark: SparkSession) -> DataFrame:
    rows = [(i, *hub) for i, hub in enumerate(MAP_HUBS)]
    return spark.createDataFrame(
        rows,
        "position int, id string, name string, code string, lat double, lng double, type string, country string",
    )


def dim_vendors(spark: SparkSession) -> DataFrame:
    """Vendor master plus the default vendor; the hub code is the natural key."""
    rows = [(v[4], *v) for v in VENDORS]
    rows.append((DEFAULT_VENDOR_ID, "Default Vendor", None, None, None, None, None))
    return spark.createDataFrame(
        rows,
        "id string, name string, tier int, country string, region string, hub_code string, reliability_score double",
    )
