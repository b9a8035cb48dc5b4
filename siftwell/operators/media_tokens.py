"""What stands in a text for an image, a video or an audio: the token rules of multimodal models, as expressions.

Pixels are prepared outside; a medium comes as a struct column whose fields say what its rule needs:

* ``grid`` array<long>: [t, h, w] patches (images: t = 1); for tiled images [rows, columns] of tiles
* ``height``, ``width`` long: the prepared size in pixels; ``frames`` long: frames of a video
* ``patches`` array<long>: tiles of an image, or of each frame of a video (or crops beside an image)
* ``seconds`` array<double>: times of a video's frames; ``length`` long: feature frames of an audio
* ``features`` long: tokens that the model's own unpadding leaves
* ``text`` string: a placeholder that a model's own processor wrote

Only the fields of the rules that are used need to be there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A medium and its number among those of its kind (from 1) to the text that stands for it.
Rule = Callable[["Tokens", Column, Column], Column]


@dataclass(frozen=True)
class Tokens:
    """Tokens and sizes of one model."""

    image: str = "<image>"
    video: str = "<video>"
    audio: str = "<audio>"
    vision_start: str = "<|vision_start|>"
    vision_end: str = "<|vision_end|>"
    audio_start: str = "<|audio_start|>"
    audio_end: str = "<|audio_end|>"
    whole_image: str = ""  # all of an image's tokens, where they are always the same
    whole_audio: str = ""
    image_break: str = "[IMG_BREAK]"
    image_end: str = "[IMG_END]"
    patch: int = 14
    merge: int = 2
    image_length: int = 256  # tokens of one tile
    additional: int = 1  # further tokens of an image, such as a class token
    drop_class: bool = True  # the class token goes
    crops: bool = False


@dataclass(frozen=True)
class MediaPlugin:
    tokens: Tokens = Tokens()
    image: Rule | None = None
    video: Rule | None = None
    audio: Rule | None = None


def _times(token: str, n: Column) -> Column:
    return F.repeat(F.lit(token), n.cast("int"))


def _product(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(1).cast("long"), lambda a, x: a * x)


def _merged(grid: Column, t: Tokens) -> Column:
    return F.floor(_product(grid) / (t.merge * t.merge))


def _patches(m: Column, t: Tokens) -> Column:
    return F.floor(m["height"] / t.patch) * F.floor(m["width"] / t.patch)


def _framed(kind: str) -> Rule:
    """The tokens of a merged grid between the vision tokens."""
    return lambda t, m, i: F.concat(F.lit(t.vision_start), _times(getattr(t, kind), _merged(m["grid"], t)), F.lit(t.vision_end))


def _frame_tokens(t: Tokens, m: Column) -> Column:
    return F.floor(m["grid"][1] * m["grid"][2] / (t.merge * t.merge))


def _seconds(m: Column, k: Column) -> Column:
    """A frame's time; frames beyond the known times take the last one, without any it is 0."""
    known = F.size(m["seconds"])
    return F.when(known > 0, F.element_at(m["seconds"], F.least(k, F.greatest(known, F.lit(1))))).otherwise(F.lit(0.0))


def _numbers(m: Column) -> Column:
    return F.filter(F.sequence(F.lit(1), F.greatest(m["grid"][0].cast("int"), F.lit(1))), lambda k: k <= m["grid"][0])


def _plain_number(x: Column) -> Column:
    """A time as Python writes it."""
    return F.when(x == F.floor(x), F.concat(F.floor(x).cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def _timed_frames(t: Tokens, m: Column, i: Column) -> Column:
    frame = lambda k: F.concat(F.format_string("<%.1f seconds>", _seconds(m, k)), F.lit(t.vision_start), _times(t.video, _frame_tokens(t, m)), F.lit(t.vision_end))
    return F.array_join(F.transform(_numbers(m), frame), "")


def _glm_video(t: Tokens, m: Column, i: Column) -> Column:
    frame = lambda k: F.concat(F.lit("<|begin_of_image|>"), _times(t.image, _frame_tokens(t, m)), F.lit("<|end_of_image|>"), _plain_number(_seconds(m, k)))
    return F.concat(F.lit("<|begin_of_video|>"), F.array_join(F.transform(_numbers(m), frame), ""), F.lit("<|end_of_video|>"))


def _tiles(t: Tokens, n: Column) -> Column:
    return F.concat(F.lit("<img>"), _times("<IMG_CONTEXT>", n * t.image_length), F.lit("</img>"))


def _intern_video(t: Tokens, m: Column, i: Column) -> Column:
    return F.array_join(F.transform(m["patches"], lambda n, k: F.concat(F.lit("Frame"), (k + 1).cast("string"), F.lit(": "), _tiles(t, n))), "\n")


def _rows_of_patches(t: Tokens, m: Column, i: Column) -> Column:
    """Rows of image tokens, each ended by a break, the last one by the end token."""
    side = t.patch * t.merge
    row = F.concat(_times(t.image, F.floor(m["width"] / side)), F.lit(t.image_break))
    rows = F.repeat(row, F.floor(m["height"] / side).cast("int"))
    return F.concat(F.left(rows, F.length(rows) - len(t.image_break)), F.lit(t.image_end))


def _tiled_image(t: Tokens, m: Column, i: Column) -> Column:
    """Tiles row by row with separators, then the whole image; one tile is the whole image alone."""
    tile = _times("<|patch|>", m["patches"][0])
    row = F.concat(F.array_join(F.array_repeat(tile, m["grid"][1].cast("int")), "<|tile_x_separator|>"), F.lit("<|tile_y_separator|>"))
    tiles = F.when(m["grid"][0] * m["grid"][1] > 1, F.repeat(row, m["grid"][0].cast("int"))).otherwise(F.lit(""))
    return F.concat(F.lit("<|image_start|>"), tiles, F.lit(t.image), tile, F.lit("<|image_end|>"))


def _llava_length(t: Tokens, m: Column) -> Column:
    return _patches(m, t) + (t.additional - int(t.drop_class))


def _gemma_image(t: Tokens, m: Column, i: Column) -> Column:
    if not t.crops:
        return F.lit(t.whole_image)
    return F.concat(F.lit(f"Here is the original image {t.whole_image} and here are some crops to help you see better "), F.array_join(F.array_repeat(F.lit(t.whole_image), m["patches"][0].cast("int")), " "))


def _audio_tokens(t: Tokens, n: Column) -> Column:
    return F.concat(F.lit(t.audio_start), _times(t.audio, n), F.lit(t.audio_end))


def _halved(t: Tokens, m: Column, i: Column) -> Column:
    """Two convolutions of stride two."""
    once = F.floor((m["length"] - 1) / 2) + 1
    return _audio_tokens(t, F.floor((once - 2) / 2) + 1)


def _numbered(word: str, mark: str, kind: str) -> Rule:
    return lambda t, m, i: F.concat(F.lit(f"{word} "), i.cast("string"), F.lit(f":<|{mark}_START|>{getattr(t, kind)}<|{mark}_END|>"))


_QWEN = MediaPlugin(Tokens("<|image_pad|>", "<|video_pad|>"), _framed("image"), _framed("video"))
_GEMMA = "\n\n<start_of_image>" + "<image_soft_token>" * 256 + "<end_of_image>\n\n"

PLUGINS: dict[str, MediaPlugin] = {
    "base": MediaPlugin(),
    "ernie_vl": MediaPlugin(Tokens("<|image@placeholder|>", "<|video@placeholder|>"), _numbered("Picture", "IMAGE", "image"), _numbered("Video", "VIDEO", "video")),
    "gemma3": MediaPlugin(Tokens("<image_soft_token>", whole_image=_GEMMA), _gemma_image),
    "gemma3n": MediaPlugin(Tokens("<image_soft_token>", audio="<audio_soft_token>", whole_image=_GEMMA, whole_audio="\n\n<start_of_audio>" + "<audio_soft_token>" * 188 + "<end_of_audio>\n\n"), lambda t, m, i: F.lit(t.whole_image), audio=lambda t, m, i: F.lit(t.whole_audio)),
    "glm4v": MediaPlugin(Tokens("<|image|>", "<|video|>"), lambda t, m, i: F.concat(F.lit("<|begin_of_image|>"), _times(t.image, _merged(m["grid"], t)), F.lit("<|end_of_image|>")), _glm_video),
    "intern_vl": MediaPlugin(Tokens(), lambda t, m, i: _tiles(t, m["patches"][0]), _intern_video),
    "kimi_vl": MediaPlugin(Tokens("<|media_pad|>"), lambda t, m, i: F.concat(F.lit("<|media_start|>image<|media_content|>"), _times(t.image, _merged(m["grid"], t)), F.lit("<|media_end|>"))),
    "llama4": MediaPlugin(Tokens("<|image|>"), _tiled_image),
    "llava": MediaPlugin(Tokens(), lambda t, m, i: _times(t.image, _llava_length(t, m))),
    "llava_next": MediaPlugin(Tokens(), lambda t, m, i: _times(t.image, m["features"] - int(t.drop_class))),
    "llava_next_video": MediaPlugin(Tokens(), lambda t, m, i: _times(t.image, m["features"] - int(t.drop_class)), lambda t, m, i: _times(t.video, F.floor(_patches(m, t) / 4) * m["frames"])),
    "minicpm_v": MediaPlugin(Tokens(), lambda t, m, i: m["text"], lambda t, m, i: m["text"], lambda t, m, i: m["text"]),
    "mllama": MediaPlugin(Tokens("<|image|>"), lambda t, m, i: F.lit(t.image)),
    "paligemma": MediaPlugin(Tokens(), lambda t, m, i: F.lit("")),
    "pixtral": MediaPlugin(Tokens("[IMG]", patch=16, merge=1), _rows_of_patches),
    "qwen2_audio": MediaPlugin(Tokens(audio="<|AUDIO|>", audio_start="<|audio_bos|>", audio_end="<|audio_eos|>"), audio=_halved),
    "qwen2_omni": replace(_QWEN, tokens=replace(_QWEN.tokens, audio="<|audio_pad|>"), audio=lambda t, m, i: _audio_tokens(t, m["length"])),
    "qwen2_vl": _QWEN,
    "qwen3_vl": replace(_QWEN, video=_timed_frames),
    "video_llava": MediaPlugin(Tokens(), lambda t, m, i: _times(t.image, _llava_length(t, m)), lambda t, m, i: _times(t.video, (_patches(m, t) + t.additional) * m["frames"])),
}

PLACEHOLDERS = {"image": "<image>", "video": "<video>", "audio": "<audio>"}


def register_plugin(name: str, plugin: MediaPlugin) -> None:
    if name in PLUGINS:
        raise ValueError(f"plug-in {name} is registered already")
    PLUGINS[name] = plugin


def plugin(name: str, **tokens) -> MediaPlugin:
    """A registered plug-in, some of its tokens or sizes replaced."""
    if name not in PLUGINS:
        raise ValueError(f"unknown plug-in {name}; there are {sorted(PLUGINS)}")
    return replace(PLUGINS[name], tokens=replace(PLUGINS[name].tokens, **tokens))


def media_text(content: Column, kind: str, media: Column, using: MediaPlugin, before: Column | None = None, expand: bool = True) -> Column:
    """A text whose placeholders of a kind are replaced by its media's tokens, in order.

    before: how many media of the kind earlier texts hold.  Without expand each medium is one
    token.  A placeholder without a medium fails while running; so does a kind that the model
    doesn't take.
    """
    rule: Rule | None = getattr(using, kind)
    parts = F.split(content, PLACEHOLDERS[kind])
    before = F.lit(0) if before is None else before
    if rule is None:
        return F.when(F.size(parts) > 1, F.raise_error(F.lit(f"this model takes no {kind}")).cast("string")).otherwise(content)
    one = F.lit(getattr(using.tokens, kind))

    def stands(p: Column, i: Column) -> Column:
        m = F.element_at(media, (before + i).cast("int"))
        made = rule(using.tokens, m, before + i) if expand else one
        return F.concat(F.when(i == 0, F.lit("")).otherwise(F.when(F.size(media) < before + i, F.raise_error(F.lit(f"a placeholder has no {kind}")).cast("string")).otherwise(made)), p)

    # the first part has no medium before it; place 1 stands in for its unused rule
    first = F.element_at(parts, 1)
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: stands(p, i + 1))
    return F.concat(first, F.array_join(rest, ""))


def with_media(messages: Column, using: MediaPlugin, expand: bool = True, **media: Column) -> Column:
    """Messages (array<struct<role, content>>) whose media stand as tokens; numbers run on from message to message.

    media names the kinds (image, video, audio) and their arrays of medium structs.
    """
    for kind, column in media.items():
        messages = _with_kind(messages, kind, column, using, expand)
    return messages


def _with_kind(messages: Column, kind: str, media: Column, using: MediaPlugin, expand: bool) -> Column:
    counts = F.transform(messages, lambda x: F.size(F.split(x["content"], PLACEHOLDERS[kind])) - 1)
    earlier = lambda i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    return F.transform(messages, lambda x, i: F.struct(x["role"].alias("role"), media_text(x["content"], kind, media, using, earlier(i), expand).alias("content")))


def image_prefix(ids: Column, labels: Column, images: Column, image_id: int, length: int, ignore: int = -100) -> Column:
    """struct(input_ids, labels): every image's tokens put before the text's, as models with a fixed image prefix want."""
    n = F.size(images) * length
    return F.struct(F.concat(F.array_repeat(F.lit(image_id), n), ids).alias("input_ids"), F.concat(F.array_repeat(F.lit(ignore), n), labels).alias("labels"))


def prefix_types(length: Column, images: Column, per_image: int) -> Column:
    """0 for the image prefix, 1 for the text behind it."""
    n = F.size(images) * per_image
    return F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), length - n))
