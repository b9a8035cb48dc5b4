"""Golden texts of media placeholders per plug-in."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions.templates import TEMPLATES
from siftwell.operators import media_tokens as M

MEDIUM = "named_struct('grid', array(1L, 4L, 4L), 'height', 28L, 'width', 42L, 'frames', 2L, 'patches', array(2L, 1L), 'seconds', array(0D, 0.5D), 'length', 9L, 'features', 7L, 'text', '(x)')"
VIDEO = MEDIUM.replace("array(1L, 4L, 4L)", "array(2L, 4L, 2L)")

#: plug-in: options, text with placeholders, what it becomes
GOLDEN = {
    "ernie_vl": ({}, "a <image> b <image>", "a Picture 1:<|IMAGE_START|><|image@placeholder|><|IMAGE_END|> b Picture 2:<|IMAGE_START|><|image@placeholder|><|IMAGE_END|>"),
    "gemma3": ({"whole_image": "[I]"}, "<image>?", "[I]?"),
    "glm4v": ({}, "<image>|<video>", "<|begin_of_image|>" + "<|image|>" * 4 + "<|end_of_image|>|<|begin_of_video|><|begin_of_image|><|image|><|image|><|end_of_image|>0.0<|begin_of_image|><|image|><|image|><|end_of_image|>0.5<|end_of_video|>"),
    "intern_vl": ({"image_length": 2}, "<image>|<video>", "<img>" + "<IMG_CONTEXT>" * 4 + "</img>|Frame1: <img>" + "<IMG_CONTEXT>" * 4 + "</img>\nFrame2: <img>" + "<IMG_CONTEXT>" * 2 + "</img>"),
    "kimi_vl": ({}, "<image>", "<|media_start|>image<|media_content|>" + "<|media_pad|>" * 4 + "<|media_end|>"),
    "llava": ({}, "<image>", "<image>" * 6),
    "llava_next": ({}, "x<image>", "x" + "<image>" * 6),
    "llava_next_video": ({"patch": 7}, "<video>", "<video>" * 12),
    "minicpm_v": ({}, "<image>.", "(x)."),
    "mllama": ({}, "<image>.", "<|image|>."),
    "paligemma": ({}, "<image>.", "."),
    "pixtral": ({"patch": 14}, "<image>", "[IMG][IMG][IMG][IMG_BREAK][IMG][IMG][IMG][IMG_END]"),
    "qwen2_audio": ({}, "<audio>", "<|audio_bos|><|AUDIO|><|AUDIO|><|audio_eos|>"),
    "qwen2_omni": ({}, "<audio><image>", "<|audio_start|>" + "<|audio_pad|>" * 9 + "<|audio_end|><|vision_start|>" + "<|image_pad|>" * 4 + "<|vision_end|>"),
    "qwen2_vl": ({}, "a<image>b<video>", "a<|vision_start|>" + "<|image_pad|>" * 4 + "<|vision_end|>b<|vision_start|>" + "<|video_pad|>" * 4 + "<|vision_end|>"),
    "qwen3_vl": ({}, "<video>", "<0.0 seconds><|vision_start|><|video_pad|><|video_pad|><|vision_end|><0.5 seconds><|vision_start|><|video_pad|><|video_pad|><|vision_end|>"),
    "video_llava": ({}, "<image><video>", "<image>" * 6 + "<video>" * 14),
}


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(1).withColumn("images", F.expr(f"array({MEDIUM}, {MEDIUM})")).withColumn("videos", F.expr(f"array({VIDEO})")).withColumn("audios", F.expr(f"array({MEDIUM})"))


def test_golden_texts(df):
    for name, (options, text, want) in GOLDEN.items():
        p = M.plugin(name, **options)
        c = F.lit(text)
        for kind, column in (("image", "images"), ("video", "videos"), ("audio", "audios")):
            if getattr(p, kind) is not None:
                c = M.media_text(c, kind, F.col(column), p)
        assert df.select(c).first()[0] == want, name


def test_tiles_and_crops(df):
    four = MEDIUM.replace("array(1L, 4L, 4L)", "array(2L, 2L)").replace("array(2L, 1L)", "array(1L)")
    d = df.withColumn("images", F.expr(f"array({four})"))
    got = d.select(M.media_text(F.lit("<image>"), "image", F.col("images"), M.plugin("llama4")), M.media_text(F.lit("<image>"), "image", F.col("images"), M.plugin("gemma3", whole_image="I", crops=True))).first()
    row = "<|patch|><|tile_x_separator|><|patch|><|tile_y_separator|>"
    assert got[0] == f"<|image_start|>{row}{row}<|image|><|patch|><|image_end|>"
    assert got[1] == "Here is the original image I and here are some crops to help you see better I"


def test_numbers_run_on_over_messages(df):
    d = df.withColumn("m", F.expr("array(named_struct('role', 'user', 'content', '<image>a'), named_struct('role', 'assistant', 'content', 'b'), named_struct('role', 'user', 'content', '<image>c<video>'))"))
    got = d.select(M.with_media(F.col("m"), M.plugin("ernie_vl"), image=F.col("images"), video=F.col("videos")).alias("m"), M.with_media(F.col("m"), M.plugin("qwen2_vl"), expand=False, image=F.col("images"), video=F.col("videos")).alias("one")).first()
    assert [x.content for x in got.m] == ["Picture 1:<|IMAGE_START|><|image@placeholder|><|IMAGE_END|>a", "b", "Picture 2:<|IMAGE_START|><|image@placeholder|><|IMAGE_END|>cVideo 1:<|VIDEO_START|><|video@placeholder|><|VIDEO_END|>"]
    assert [x.content for x in got.one] == ["<|image_pad|>a", "b", "<|image_pad|>c<|video_pad|>"]


def test_missing_media_and_unknown_kinds_fail(df):
    with pytest.raises(Exception, match="has no image"):
        df.select(M.media_text(F.lit("<image><image><image>"), "image", F.col("images"), M.plugin("qwen2_vl"))).collect()
    with pytest.raises(Exception, match="takes no video"):
        df.select(M.media_text(F.lit("<video>"), "video", F.col("videos"), M.plugin("llava"))).collect()


def test_prefixes_and_registry(df):
    got = df.select(M.image_prefix(F.array(F.lit(5), F.lit(6)), F.array(F.lit(-100), F.lit(6)), F.col("images"), 9, 2).alias("p"), M.prefix_types(F.lit(6), F.col("images"), 2).alias("t")).first()
    assert (got.p.input_ids, got.p.labels, got.t) == ([9, 9, 9, 9, 5, 6], [-100] * 5 + [6], [0, 0, 0, 0, 1, 1])
    assert len(M.PLUGINS) == 20 and {t.media for t in TEMPLATES.values()} <= set(M.PLUGINS)
    with pytest.raises(ValueError):
        M.register_plugin("llava", M.MediaPlugin())
