"""SQL definitions of the derived tables, shared by the oracle texts."""

from __future__ import annotations

CTE: dict[str, str] = {}

CTE["projects"] = """SELECT r_regionkey AS project_id, r_name AS name,
  'Taluka '||r_regionkey||', District '||(r_regionkey%3)||', State '||(r_regionkey%2) AS location,
  CASE WHEN r_regionkey%2=0 THEN 'Rural Cadastral Mapping' ELSE 'Cadastral Survey Project' END AS project_type,
  r_regionkey=4 AS is_demo, CASE WHEN r_regionkey=3 THEN 'Completed' ELSE 'Created' END AS status,
  18e0+r_regionkey*0.25e0 AS lat, 73e0+r_regionkey*0.5e0 AS lng FROM region"""

CTE["imagery"] = """SELECT n_nationkey AS imagery_id, n_regionkey AS project_id,
  lower(n_name)||CASE WHEN n_nationkey%5=0 THEN '.tif' ELSE '.jpg' END AS file_name, 4000 AS width, 3000 AS height,
  n_nationkey%5=0 AS is_georeferenced, 18e0+n_regionkey*0.25e0+n_nationkey*0.01e0 AS lat,
  73e0+n_regionkey*0.5e0+n_nationkey*0.01e0 AS lng FROM nation"""

CTE["parcels"] = """SELECT o.o_orderkey AS parcel_id, c.c_nationkey AS imagery_id, n.n_regionkey AS project_id,
  200+(o.o_orderkey*37)%3600 AS x0, 200+(o.o_orderkey*91)%2600 AS y0,
  CASE WHEN o.o_orderkey%61=0 THEN 300 ELSE 20+(o.o_orderkey*13)%120 END AS w,
  CASE WHEN o.o_orderkey%61=0 THEN 2 ELSE 20+(o.o_orderkey*29)%90 END AS h,
  CASE WHEN o.o_orderkey%41=0 THEN 'bowtie' WHEN o.o_orderkey%53=0 THEN 'open'
       WHEN o.o_orderkey%47=0 THEN 'dupvertex' ELSE 'quad' END AS shape,
  CASE WHEN o.o_orderkey%97=0 THEN 'Deleted' WHEN o.o_orderkey%89=0 THEN 'split'
       WHEN o.o_orderstatus='F' THEN 'accepted' WHEN o.o_orderstatus='O' THEN 'needs_review' ELSE 'rejected' END AS status,
  CASE WHEN o.o_orderkey%71=0 THEN NULL ELSE (40+o.o_orderkey%60)/100e0 END AS confidence,
  CASE WHEN o.o_orderkey%83=0 THEN o.o_orderkey-1 END AS parent_parcel_id,
  CASE WHEN o.o_orderkey%67=0 THEN 'Possible gap near '||(o.o_orderkey+25)
       WHEN o.o_orderkey%73=0 THEN 'Shares border with '||(o.o_orderkey+50)
       WHEN o.o_orderkey%79=0 THEN 'Touches water mask' END AS topology_issue,
  c.c_nationkey%5=0 AS is_georeferenced, o.o_orderdate AS created_at
FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey"""

CTE["vertices"] = """SELECT p.parcel_id, p.imagery_id, p.status, k.i AS seq,
  CAST(CASE WHEN k.i=0 THEN x0 WHEN k.i=1 THEN x0+w WHEN k.i=2 AND shape='dupvertex' THEN x0+w
       WHEN k.i-CASE WHEN shape='dupvertex' THEN 1 ELSE 0 END=2 THEN CASE WHEN shape='bowtie' THEN x0 ELSE x0+w END
       WHEN k.i-CASE WHEN shape='dupvertex' THEN 1 ELSE 0 END=3 THEN CASE WHEN shape='bowtie' THEN x0+w ELSE x0+5 END
       ELSE x0 END AS DOUBLE) AS x,
  CAST(CASE WHEN k.i=0 OR k.i=1 OR (k.i=2 AND shape='dupvertex') THEN y0
       WHEN k.i-CASE WHEN shape='dupvertex' THEN 1 ELSE 0 END IN (2,3) THEN y0+h ELSE y0 END AS DOUBLE) AS y
FROM parcels p CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5)) AS k(i)
WHERE k.i <= CASE WHEN shape='open' THEN 3 WHEN shape='dupvertex' THEN 5 ELSE 4 END"""

CTE["edges"] = """SELECT * FROM (SELECT parcel_id, imagery_id, status, seq, x AS x1, y AS y1,
  lead(x) OVER (PARTITION BY parcel_id ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY parcel_id ORDER BY seq) AS y2
  FROM vertices) t WHERE x2 IS NOT NULL"""

# repaired ring: consecutive duplicates gone, closed
CTE["rvertices"] = """SELECT parcel_id, imagery_id, status, row_number() OVER (PARTITION BY parcel_id ORDER BY seq)-1 AS seq, x, y FROM (
  SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY parcel_id ORDER BY seq) AS px, lag(y) OVER (PARTITION BY parcel_id ORDER BY seq) AS py FROM vertices) q
  WHERE px IS NULL OR abs(x-px)>1e-7 OR abs(y-py)>1e-7
  UNION ALL
  SELECT v.parcel_id, v.imagery_id, v.status, 99 AS seq, v.x, v.y, NULL, NULL FROM vertices v JOIN parcels p USING (parcel_id) WHERE v.seq=0 AND p.shape='open') u"""

CTE["redges"] = """SELECT * FROM (SELECT parcel_id, imagery_id, status, seq, x AS x1, y AS y1,
  lead(x) OVER (PARTITION BY parcel_id ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY parcel_id ORDER BY seq) AS y2
  FROM rvertices) t WHERE x2 IS NOT NULL"""

def _working(source: str) -> str:
    return f"""SELECT v.parcel_id, v.imagery_id, v.status, v.seq, m.is_georeferenced AS geo,
  CASE WHEN m.is_georeferenced THEN floor((m.lng+(x/4000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 ELSE x END AS x,
  CASE WHEN m.is_georeferenced THEN floor((m.lat-(y/3000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 ELSE y END AS y
  FROM {source} v JOIN imagery m ON v.imagery_id=m.imagery_id"""


# working vertices (degrees for georeferenced images) with their plane coordinates px, py
CTE["wv"] = f"""SELECT *, CASE WHEN geo THEN radians(x)*6371008.8e0 ELSE x END AS px, CASE WHEN geo THEN sin(radians(y))*6371008.8e0 ELSE y END AS py FROM (
  SELECT 'raw' AS kind, * FROM ({_working('vertices')}) a UNION ALL SELECT 'clean', * FROM ({_working('rvertices')}) b) u"""

CTE["wedges"] = """SELECT * FROM (SELECT kind, parcel_id, imagery_id, geo, status, seq, x AS x1, y AS y1, px AS px1, py AS py1,
  lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(px) OVER w AS px2, lead(py) OVER w AS py2
  FROM wv WINDOW w AS (PARTITION BY kind, parcel_id ORDER BY seq)) t WHERE x2 IS NOT NULL"""

CTE["sizes"] = """SELECT kind, parcel_id, abs(sum(px1*py2-px2*py1))/2 AS cross_area, abs(sum((px2-px1)*(py1+py2)))/2 AS trap_area,
  sum(CASE WHEN geo THEN 2*6371008.8e0*atan2(sqrt(hav), sqrt(1-hav)) ELSE sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) END) AS len
  FROM (SELECT *, pow(sin(radians(y2-y1)/2),2)+cos(radians(y1))*cos(radians(y2))*pow(sin(radians(x2-x1)/2),2) AS hav FROM wedges) e GROUP BY 1,2"""

CTE["crossings"] = """SELECT a.parcel_id, count(*) AS kinks FROM wedges a JOIN wedges b ON a.parcel_id=b.parcel_id AND b.seq>=a.seq+2
  JOIN (SELECT parcel_id, max(seq) AS last FROM wedges WHERE kind='clean' GROUP BY 1) l ON l.parcel_id=a.parcel_id
  WHERE a.kind='clean' AND b.kind='clean' AND NOT (a.seq=0 AND b.seq=l.last)
  AND ((b.y2-a.y1)*(b.x1-a.x1)>(b.y1-a.y1)*(b.x2-a.x1)) <> ((b.y2-a.y2)*(b.x1-a.x2)>(b.y1-a.y2)*(b.x2-a.x2))
  AND ((b.y1-a.y1)*(a.x2-a.x1)>(a.y2-a.y1)*(b.x1-a.x1)) <> ((b.y2-a.y1)*(a.x2-a.x1)>(a.y2-a.y1)*(b.x2-a.x1)) GROUP BY 1"""

CTE["facts"] = """SELECT p.parcel_id, p.imagery_id, p.project_id, p.status, p.confidence, p.topology_issue, p.shape, p.is_georeferenced AS geo,
  coalesce(k.kinks,0) AS kinks, CASE WHEN p.is_georeferenced THEN c.trap_area ELSE c.cross_area END AS area, c.len,
  CASE WHEN p.is_georeferenced THEN c.trap_area ELSE r.cross_area END AS raw_area, r.len AS raw_len,
  4*pi()*(CASE WHEN p.is_georeferenced THEN c.trap_area ELSE c.cross_area END)/(c.len*c.len) AS comp,
  4*pi()*(CASE WHEN p.is_georeferenced THEN c.trap_area ELSE r.cross_area END)/(r.len*r.len) AS raw_comp,
  coalesce(k.kinks,0)=0 AND (CASE WHEN p.is_georeferenced THEN c.trap_area ELSE c.cross_area END)>0.0001 AS valid
  FROM parcels p JOIN sizes c ON c.parcel_id=p.parcel_id AND c.kind='clean' JOIN sizes r ON r.parcel_id=p.parcel_id AND r.kind='raw'
  LEFT JOIN crossings k ON k.parcel_id=p.parcel_id"""

CTE["slivers"] = """SELECT * FROM facts WHERE status NOT IN ('Deleted','split') AND valid AND (
  raw_area<CASE WHEN geo THEN 60 ELSE 800 END OR (raw_comp<0.08e0 AND raw_area<CASE WHEN geo THEN 300 ELSE 3000 END))"""

CTE["features"] = """SELECT ((l_orderkey*10+l_linenumber)*100000+l_partkey)*1000+l_suppkey AS feature_id,
  CAST(l_suppkey%25 AS INT) AS imagery_id, CAST(l_suppkey%5 AS INT) AS project_id,
  CASE l_linenumber WHEN 1 THEN 'ROAD' WHEN 2 THEN 'BUILDING' WHEN 3 THEN 'FIELD' WHEN 4 THEN 'WALL'
       WHEN 5 THEN 'FENCE' WHEN 6 THEN 'VEGETATION' ELSE 'WATER' END AS detection_type,
  200+(l_partkey*71+l_orderkey*17)%3600 AS fx, 200+(l_partkey*43+l_orderkey*59)%2600 AS fy,
  10+(l_orderkey*7+l_partkey)%90 AS fw, 10+(l_partkey*11)%70 AS fh,
  (30+CAST(l_quantity AS INT))/100e0 AS confidence, l_returnflag<>'R' AS is_valid,
  CASE WHEN l_partkey%3=0 THEN 'ml' ELSE 'cv' END AS provider,
  CASE WHEN l_linenumber=7 AND l_partkey%4=0 THEN 'canal' END AS sub_type, l_shipdate AS created_at FROM lineitem"""

CTE["fvertices"] = """SELECT f.feature_id, f.imagery_id, f.detection_type, k.i AS seq,
  CAST(CASE WHEN k.i IN (1,2) THEN fx+fw ELSE fx END AS DOUBLE) AS x,
  CAST(CASE WHEN k.i IN (2,3) THEN fy+fh ELSE fy END AS DOUBLE) AS y
FROM features f CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS k(i)
WHERE k.i <= CASE WHEN detection_type IN ('ROAD','WALL','FENCE') THEN 2 ELSE 4 END"""

CTE["fedges"] = """SELECT f.feature_id, f.imagery_id, f.detection_type, k.i AS seg,
  CAST(CASE WHEN k.i IN (1,2) THEN fx+fw ELSE fx END AS DOUBLE) AS x1, CAST(CASE WHEN k.i IN (2,3) THEN fy+fh ELSE fy END AS DOUBLE) AS y1,
  CAST(CASE WHEN k.i IN (0,1) THEN fx+fw ELSE fx END AS DOUBLE) AS x2, CAST(CASE WHEN k.i IN (1,2) THEN fy+fh ELSE fy END AS DOUBLE) AS y2
FROM features f CROSS JOIN (VALUES (0),(1),(2),(3)) AS k(i)
WHERE k.i <= CASE WHEN detection_type IN ('ROAD','WALL','FENCE') THEN 1 ELSE 3 END"""

CTE["events_fx"] = """SELECT event_id, user_id AS parcel_id, ts, CASE event_type WHEN 'purchase' THEN 'Accepted' WHEN 'error' THEN 'Rejected'
  WHEN 'signup' THEN 'Needs Review' ELSE 'Edited' END AS action, event_type, value FROM events"""

CTE["uploads"] = """SELECT o_orderkey AS upload_id, CAST(o_custkey%5 AS INT) AS project_id,
  'Flight_'||o_orderkey||CASE o_orderkey%5 WHEN 0 THEN '.TIF' WHEN 1 THEN '.tiff' WHEN 2 THEN '.jpg' WHEN 3 THEN '.png' ELSE '.JPEG' END AS file_name,
  o_orderkey*7919%400000000 AS size_bytes, CASE WHEN o_orderkey%7=0 THEN o_orderstatus='F' END AS flag_georeferenced,
  CASE WHEN o_orderkey%11=0 THEN o_orderstatus='O' END AS meta_georeferenced,
  CASE WHEN o_orderkey%4=0 THEN 'EPSG:4326' WHEN o_orderkey%4=1 THEN 'PixelSpace' END AS crs,
  CASE WHEN o_orderkey%3=0 THEN CAST(1000+o_orderkey%5000 AS INT) END AS width,
  CASE WHEN o_orderkey%3=0 THEN CAST(800+o_orderkey%4000 AS INT) END AS height, o_orderdate AS uploaded_at FROM orders"""

CTE["activities"] = """SELECT e.event_id AS activity_id, p.project_id, e.action AS type, e.ts FROM events_fx e JOIN parcels p USING (parcel_id)"""
CTE["jobs"] = """SELECT o_orderkey AS job_id, CAST(o_custkey%5 AS INT) AS project_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status,
  CASE o_orderstatus WHEN 'O' THEN 20 ELSE 100 END AS progress, o_orderdate AS started_at FROM orders"""
CTE["plots"] = """SELECT o_orderkey AS plot_id, o_orderkey||CASE WHEN o_orderkey%10=4 THEN 'A' ELSE '' END AS plot_no, (o_orderkey%97)||'/'||(o_orderkey%7) AS survey_no, c_name AS owner,
  'Village '||(o_orderkey%23) AS village, CASE o_orderpriority WHEN '1-URGENT' THEN 'Commercial' WHEN '2-HIGH' THEN 'Residential' WHEN '3-MEDIUM' THEN 'Agricultural' WHEN '4-NOT SPECIFIED' THEN 'Government' ELSE 'Industrial' END AS land_type,
  CASE o_orderstatus WHEN 'F' THEN 'Clear Title' WHEN 'O' THEN 'Under Survey' ELSE 'Disputed' END AS title_status, (o_orderkey*13%500+20)/100e0 AS area_acre FROM orders JOIN customer ON o_custkey=c_custkey"""
CTE["rejections"] = """SELECT feature_id AS item_id, imagery_id, lower(detection_type) AS feature_class, CASE fw%11 WHEN 0 THEN 'Water crossing' WHEN 1 THEN 'Unsupported line' WHEN 2 THEN 'Image-edge artifact'
  WHEN 3 THEN 'Insufficient continuity' WHEN 4 THEN 'Invalid geometry' WHEN 5 THEN 'Duplicate geometry' WHEN 6 THEN 'Weak evidence' WHEN 7 THEN 'Excessive size' WHEN 8 THEN 'Disconnected feature' WHEN 9 THEN 'Other cause' END AS category,
  confidence AS score FROM features WHERE NOT is_valid"""

_KIND = "(x//8*7+y//8*5+imagery_id*3+x//24)%8"


def _channel(ch: int) -> str:
    from cadastre.sources.derived import PALETTE

    cases = " ".join(f"WHEN {i} THEN {rgb[ch]}" for i, rgb in enumerate(PALETTE))
    return f"CAST((CASE {_KIND} {cases} END)+((x*7+y*3+o_custkey*11)%13)*{ch + 1}%13 AS INT)"


CTE["pixels"] = f"""SELECT imagery_id, x, y, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b
FROM (SELECT o_orderkey//48 AS imagery_id, CAST(o_orderkey%48 AS INT) AS y, o_custkey FROM orders) t
CROSS JOIN (SELECT CAST(range AS INT) AS x FROM range(0, 64)) k"""

NEEDS = {
    "activities": ["parcels", "events_fx"], "rejections": ["features"],
    "wv": ["vertices", "rvertices", "imagery"], "wedges": ["wv"], "sizes": ["wedges"], "crossings": ["wedges"],
    "facts": ["sizes", "crossings"], "slivers": ["facts"],
    "vertices": ["parcels"], "edges": ["vertices"], "rvertices": ["vertices"], "redges": ["rvertices"],
    "fvertices": ["features"], "fedges": ["features"],
}
ORDER = ["projects", "imagery", "parcels", "vertices", "edges", "rvertices", "redges", "wv", "wedges", "sizes", "crossings", "facts", "slivers", "features", "fvertices",
         "fedges", "events_fx", "uploads", "activities", "jobs", "plots", "rejections", "pixels"]


def sql(*tables: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named derived tables in scope; ``body`` may continue the WITH list after a comma."""
    wanted: set[str] = set()

    def need(name):
        for dep in NEEDS.get(name, []):
            need(dep)
        wanted.add(name)

    for t in tables:
        need(t)
    ctes = ",\n".join(f"{t} AS ({CTE[t]})" for t in ORDER if t in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body if body.lstrip().startswith(',') else ' ' + body}"
