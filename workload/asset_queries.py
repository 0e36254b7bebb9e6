"""Packs, models, shapes and textures (ids S7, J16, F27, F28, A12, A23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.sources import assets

from . import views as fx
from .views import define, oracle

_ELEMENT = "array<struct<from:array<double>,to:array<double>,faces:array<string>>>"


def pack_files(spark, sf):
    """Asset files in eight packs: many paths exist in several of them."""
    k = F.col("p_partkey")
    return fx.table(spark, sf, "part").select(
        (k % 8).cast("int").alias("pack"), F.concat(F.lit("models/"), F.floor(k / 40).cast("string"), F.lit("_"), (k % 5).cast("string")).alias("asset"),
        F.col("p_name").alias("content"), "p_partkey",
    ).groupBy("pack", "asset").agg(F.max_by("content", "p_partkey").alias("content"))


def models(spark, sf):
    """A forest of models: most inherit from a lower number, some form cycles or dangle."""
    k = F.col("p_partkey")
    ref = lambda n: F.concat(F.lit("m"), n.cast("string"))
    parent = F.when(k % 97 == 5, ref(k + 1)).when(k % 97 == 6, ref(k - 1)).when(k % 89 == 1, F.lit("builtin/generated")).when(k % 83 == 2, F.lit("gone")).when(k > 0, ref(k - 1 - k % 4))
    cube = F.struct(F.array(*[F.lit(0.0)] * 3).alias("from"), F.array(*[F.lit(16.0)] * 3).alias("to"), F.array(F.lit("up"), F.lit("down")).alias("faces"))
    sheet = F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(8.0)).alias("from"), F.array(F.lit(16.0), (k % 20).cast("double"), F.lit(8.0)).alias("to"), F.array(F.lit("north")).alias("faces"))
    elements = F.when(k % 11 == 0, F.array(cube)).when(k % 11 == 4, F.array(sheet, sheet)).when(k % 11 == 7, F.array(sheet)).otherwise(F.array().cast(_ELEMENT))
    textures = F.create_map(
        F.lit("top"), F.when(k % 3 == 0, F.lit("#all")).otherwise(F.concat(F.lit("t/"), F.col("p_brand"))),
        F.concat(F.lit("v"), (k % 5).cast("string")), F.when(k % 2 == 0, F.lit("#top")).otherwise(F.col("p_name")),
    )
    textures = F.when(k % 13 == 0, F.map_concat(textures, F.create_map(F.lit("all"), F.col("p_type")))).otherwise(textures)
    return fx.table(spark, sf, "part").select(
        assets.model_id(ref(k)).alias("model"), parent.alias("parent"), textures.alias("textures"), elements.alias("elements")
    )


define(
    "o_models",
    (),
    "SELECT p_partkey AS k,CASE WHEN p_partkey%97=5 THEN p_partkey+1 WHEN p_partkey%97=6 THEN p_partkey-1 WHEN p_partkey%89=1 OR p_partkey%83=2 THEN NULL WHEN p_partkey>0 THEN p_partkey-1-p_partkey%4 END AS parent,p_name,p_brand,p_type,"
    "CASE p_partkey%11 WHEN 0 THEN 'cube' WHEN 4 THEN 'cross' WHEN 7 THEN 'sheet' END AS shape FROM part",
)
define(
    "o_chain",
    ("o_models",),
    "SELECT k AS leaf,k,0 AS depth,[k] AS seen FROM o_models UNION ALL SELECT c.leaf,m.parent,c.depth+1,list_append(c.seen,m.parent) FROM o_chain c JOIN o_models m ON m.k=c.k JOIN o_models e ON e.k=m.parent "
    "WHERE c.depth<15 AND NOT list_contains(c.seen,m.parent)",
)
define(
    "o_vars",
    ("o_chain", "o_models"),
    "SELECT leaf,key,arg_min(v,depth) AS v FROM (SELECT c.leaf,c.depth,unnest(['top','v'||m.k%5,CASE WHEN m.k%13=0 THEN 'all' END]) AS key,unnest([CASE WHEN m.k%3=0 THEN '#all' ELSE 't/'||p_brand END,CASE WHEN m.k%2=0 THEN '#top' ELSE p_name END,p_type]) AS v FROM o_chain c JOIN o_models m USING (k)) WHERE key IS NOT NULL GROUP BY 1,2",
)


def resolved(spark, sf):
    return assets.resolve_models(models(spark, sf))


def variants(spark, sf):
    """Block state variants as objects, lists and entries without a model."""
    k = F.col("p_partkey")
    one = lambda n: F.concat(F.lit('{"model":"'), n, F.lit('","x":90}'))
    table = F.create_map(
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("facing="), (k % 7).cast("string"))),
        F.when(k % 5 == 0, F.lit('{"x":1}')).otherwise(F.concat(F.lit("["), F.lit('{"y":1},'), one(F.col("p_brand")), F.lit("]"))),
        F.when(k % 3 == 0, F.lit("axis=y")).otherwise(F.lit("half=top")),
        one(F.col("p_type")),
    )
    return fx.table(spark, sf, "part").select(k.alias("id"), table.alias("variants"))


def texels(spark, sf):
    """16 x 16 textures, one per supplier, from the lines it shipped."""
    i = lambda c: c.cast("int")
    return fx.table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("texture"), F.lit(16).alias("size"),
        i(F.col("l_partkey") % 16).alias("x"), i(F.col("l_orderkey") % 16).alias("y"),
    ).agg(
        i(F.max(F.col("l_orderkey") % 256)).alias("r"), i(F.min(F.col("l_partkey") % 256)).alias("g"), i(F.max(F.col("l_quantity") * 5)).alias("b"),
        i(F.max(F.when(F.col("l_suppkey") % 3 == 0, 255).otherwise(F.col("l_orderkey") * 3 % 256))).alias("a"),
    )


define(
    "o_mip16",
    (),
    "SELECT 't'||l_suppkey AS texture,16 AS size,CAST(l_partkey%16 AS INTEGER) AS x,CAST(l_orderkey%16 AS INTEGER) AS y,CAST(max(l_orderkey%256) AS INTEGER) AS r,CAST(min(l_partkey%256) AS INTEGER) AS g,CAST(max(l_quantity*5) AS INTEGER) AS b,"
    "CAST(max(CASE WHEN l_suppkey%3=0 THEN 255 ELSE l_orderkey*3%256 END) AS INTEGER) AS a FROM lineitem GROUP BY 1,2,3,4",
)
for _s in (8, 4, 2, 1):
    define(
        f"o_mip{_s}",
        (f"o_mip{_s * 2}",),
        f"SELECT texture,{_s} AS size,CAST(floor(x/2.0) AS INTEGER) AS x,CAST(floor(y/2.0) AS INTEGER) AS y,"
        + ",".join(f"CASE WHEN sum(a)>0 THEN CAST(floor(sum({c}*a)/sum(a)) AS INTEGER) ELSE 0 END AS {c}" for c in "rgb")
        + f",CAST(floor(sum(a)/4.0) AS INTEGER) AS a FROM o_mip{_s * 2} GROUP BY 1,3,4",
    )


def q_resolve_texture(spark, sf):
    r = resolved(spark, sf)
    return r.select("model", "chain", assets.resolve_texture(F.lit("#v2"), "textures").alias("side"), assets.resolve_texture(F.lit("#top"), "textures").alias("top"), F.size("textures").alias("variables"))


def q_downgrade(spark, sf):
    p = fx.table(spark, sf, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") % 5 > 0).alias("occludes"))
    return assets.downgrade_occluders(p, assets.has_alpha(texels(spark, sf)))


QUERIES = {
    "s7_layered_assets": lambda s, sf: assets.effective_assets(pack_files(s, sf)),
    "j16_parent_chain": lambda s, sf: assets.model_chains(models(s, sf)),
    "j16_inherited_model": q_resolve_texture,
    "f27_model_shapes": lambda s, sf: resolved(s, sf).select(
        "model", F.coalesce(assets.is_billboard("elements"), F.lit(False)).alias("billboard"), F.coalesce(assets.is_full_cube("elements"), F.lit(False)).alias("cube")),
    "f28_variant_pick": lambda s, sf: variants(s, sf).select("id", assets.pick_variant("variants").alias("model")),
    "a12_mip_levels": lambda s, sf: assets.mip_levels(texels(s, sf), 4),
    "a12_representative_color": lambda s, sf: assets.representative_color(assets.mip_levels(texels(s, sf), 4)),
    "a23_texture_alpha": lambda s, sf: assets.has_alpha(texels(s, sf)),
    "a23_occluder_downgrade": q_downgrade,
}

_REF = lambda v: (
    f"CASE WHEN {v} IS NULL THEN '' WHEN {v}='#top' THEN CASE WHEN t.v='#all' THEN coalesce(a.v,'') ELSE t.v END WHEN {v}='#all' THEN coalesce(a.v,'') ELSE {v} END"
)
ORACLE = {
    "s7_layered_assets": "SELECT pack,asset,content FROM (SELECT *,row_number() OVER (PARTITION BY asset ORDER BY pack DESC,p_partkey DESC) AS rn FROM (SELECT CAST(p_partkey%8 AS INTEGER) AS pack,'models/'||CAST(floor(p_partkey/40.0) AS INTEGER)||'_'||p_partkey%5 AS asset,p_name AS content,p_partkey FROM part)) WHERE rn=1",
    "j16_parent_chain": oracle("o_chain", "SELECT 'minecraft:m'||leaf AS model,'minecraft:m'||k AS ancestor,depth FROM o_chain", recursive=True),
    "j16_inherited_model": oracle(
        "o_chain o_vars",
        f", c AS (SELECT leaf,max(depth) AS chain FROM o_chain GROUP BY 1), n AS (SELECT leaf,CAST(count(*) AS INTEGER) AS n FROM o_vars GROUP BY 1) SELECT 'minecraft:m'||c.leaf AS model,chain,{_REF('s.v')} AS side,{_REF('t.v')} AS top,n.n AS variables "
        "FROM c JOIN n USING (leaf) LEFT JOIN (SELECT leaf,v FROM o_vars WHERE key='v2') s ON s.leaf=c.leaf LEFT JOIN (SELECT leaf,v FROM o_vars WHERE key='top') t ON t.leaf=c.leaf LEFT JOIN (SELECT leaf,v FROM o_vars WHERE key='all') a ON a.leaf=c.leaf",
        recursive=True,
    ),
    "f27_model_shapes": oracle(
        "o_chain o_models",
        ", s AS (SELECT leaf,arg_min(k,depth) AS k,arg_min(shape,depth) AS shape FROM o_chain JOIN o_models USING (k) WHERE shape IS NOT NULL GROUP BY 1) "
        "SELECT 'minecraft:m'||m.k AS model,coalesce(s.shape='cross' AND s.k%20>=14,false) AS billboard,coalesce(s.shape='cube',false) AS cube FROM o_models m LEFT JOIN s ON s.leaf=m.k",
        recursive=True,
    ),
    "f28_variant_pick": "SELECT p_partkey AS id,CASE WHEN p_partkey%4=0 AND p_partkey%5<>0 THEN p_brand WHEN p_partkey%3=0 THEN p_type WHEN p_partkey%5=0 THEN p_type WHEN p_partkey%4=0 THEN p_type ELSE p_brand END AS model FROM part",
    "a12_mip_levels": oracle("o_mip1 o_mip16", " UNION ALL ".join(f"SELECT texture,size,x,y,r,g,b,a FROM o_mip{s}" for s in (16, 8, 4, 2, 1))),
    "a12_representative_color": oracle("o_mip1", "SELECT texture,r,g,b,a FROM o_mip1"),
    "a23_texture_alpha": oracle("o_mip16", "SELECT texture,bool_or(a<>255) AS has_alpha FROM o_mip16 GROUP BY 1"),
    "a23_occluder_downgrade": oracle(
        "o_mip16",
        "SELECT 't'||s_suppkey AS name,s_suppkey%5>0 AND NOT coalesce(h,false) AS occludes FROM supplier LEFT JOIN (SELECT texture,bool_or(a<>255) AS h FROM o_mip16 GROUP BY 1) ON texture='t'||s_suppkey",
    ),
}
