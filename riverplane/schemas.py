"""Declared schemas of the engine's tables. Elevations are DOUBLE in flight; a missing value is NULL, never NaN or a sentinel."""

RASTER_META = "raster_id int, crs_epsg int, a double, b double, c double, d double, e double, f double, width int, height int, nodata double"
TILES = "raster_id int, block_row int, block_col int, h int, w int, z array<float>"
PIXELS = "raster_id int, px_row int, px_col int, z double"
VERTICES = "feature_id int, part int, ring int, seq int, x double, y double"
FEATURES = "feature_id int, name string, geom_type string, part int, ring int, seq int, x double, y double"
SEEN_ITEMS = "title string, url string, published timestamp"
CATALOG_ITEMS = "title string, url string, pub_date string, min_x double, min_y double, max_x double, max_y double"
RIVER_POINTS = "river_id int, seq int, s double, x double, y double, nx double, ny double, half_width double, z_raw double, z double"

#: JSON of the product catalogue, of the second catalogue and of flowline attributes.
CATALOG_JSON = "items array<struct<title:string,downloadURL:string,publicationDate:string,boundingBox:struct<minX:string,minY:string,maxX:string,maxY:string>>>"
SCIENCE_JSON = "items array<struct<title:string,spatial:struct<boundingBox:struct<minX:double,minY:double,maxX:double,maxY:double>>,webLinks:array<struct<type:string,title:string,uri:string>>>>"
FLOWLINE_JSON = "features array<struct<attributes:struct<gnis_name:string,lengthkm:double>>>"
GEOJSON = "crs struct<properties:struct<name:string>>, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string,geometries:string>>>"
