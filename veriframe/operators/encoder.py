"""Encoders over images: a pinned reference encoder and an optional subject, run batch-wise on the executors.

Pixels come from Spark's image source (the JVM decodes); resizing, normalisation and inference are NumPy or the ONNX
runtime. A model is loaded once a worker process, from bytes that were checked against their pin on the driver.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IntegrityError
from .gate import RANK

DIM, SIZE = 384, 224
#: Means and deviations of red, green and blue.
MEAN, STD = (np.float32(v)[None, :, None, None] for v in ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)))
HEADER = 32


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data) with rows of BGR or grey bytes, from Spark's image source."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return images.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def pixels(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """RGB array of shape (height, width, 3)."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with the triangle widened by the scale when shrinking."""

    def taps(n: int, m: int) -> np.ndarray:
        scale = max(n / m, 1.0)
        centre = (np.arange(m)[:, None] + 0.5) * n / m
        w = np.maximum(0, 1 - np.abs((np.arange(n)[None, :] + 0.5 - centre) / scale))
        return w / w.sum(axis=1, keepdims=True)

    return np.einsum("yh,hwc,xw->yxc", taps(a.shape[0], height), a.astype(np.float64), taps(a.shape[1], width), optimize=True)


def preprocess(rgb: np.ndarray, size: int = SIZE) -> np.ndarray:
    """NCHW float32 batch of one, normalised by the usual means and deviations."""
    x = np.rint(resize(rgb, size, size)).astype(np.float32) / 255.0
    return np.ascontiguousarray((x.transpose(2, 0, 1)[None] - MEAN) / STD, np.float32)


def preprocess_with(rgb: np.ndarray, config: dict) -> np.ndarray:
    """The configured form: size, scale, channel order, optional mean and deviation."""
    w, h = config.get("image_size") or (config["width"], config["height"])
    x = np.rint(resize(rgb, w, h)).astype(np.float32) * np.float32(config.get("scale", 1 / 255))
    order = [config[k] for k in ("color_format", "channel_order") if k in config]
    if order[:1] == ["BGR"]:
        x = x[:, :, ::-1]
    if config.get("normalize", {"mean", "std"} <= config.keys()):
        x = (x - np.asarray(config["mean"], np.float32)) / np.asarray(config["std"], np.float32)
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None], np.float32)


class LinearStub:
    """Stand-in encoder: mean colour times a 3 x DIM matrix plus a bias, read from a file that begins with a magic word."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows  # three of weights, then the bias

    @classmethod
    def load(cls, data: bytes, magic: bytes) -> LinearStub | None:
        if not data.startswith(magic) or len(data) < HEADER + 16 * DIM:
            return None
        return cls(np.frombuffer(data, "<f4", 4 * DIM, HEADER).reshape(4, DIM))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        colour = x[0].reshape(3, -1).mean(axis=1)
        return np.append(colour, np.float32(1)) @ self.rows


def _torch_encoder(data: bytes) -> Callable[[np.ndarray], np.ndarray] | None:
    try:
        import torch

        model = torch.jit.load(io.BytesIO(data), map_location="cpu").eval()
    except Exception:  # torch is missing or doesn't take it
        return None

    def run(x: np.ndarray) -> np.ndarray:
        with torch.inference_mode():
            return np.asarray(model(torch.from_numpy(x)).numpy(), np.float32)

    return run


def demo_model(classes: int = 10) -> bytes:
    """A small ONNX model to try inference with: mean colour, then a linear layer with fixed weights. Its few protobuf
    messages are written by hand, so that no training framework is needed to make it."""

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(k: int, value: int | str | bytes) -> bytes:
        if isinstance(value, int):
            return number(k << 3) + number(value)
        value = value.encode() if isinstance(value, str) else value
        return number(k << 3 | 2) + number(len(value)) + value

    def tensor(name: str, a: np.ndarray) -> bytes:
        return b"".join(field(1, d) for d in a.shape) + field(2, 1) + field(8, name) + field(9, a.astype("<f4").tobytes())

    def value(name: str, *shape: int | str) -> bytes:
        dims = b"".join(field(1, field(1 if isinstance(d, int) else 2, d)) for d in shape)
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, dims)))

    def node(kind: str, inputs: str, output: str) -> bytes:
        return field(1, b"".join(field(1, x) for x in inputs.split()) + field(2, output) + field(4, kind))

    weights = np.outer(np.arange(1, 4), np.arange(1, classes + 1)) / 64
    bias = np.arange(classes) / 8
    graph = node("GlobalAveragePool", "image", "mean") + node("Flatten", "mean", "colour") + node("Gemm", "colour weights bias", "logits") + field(2, "demo")
    graph += field(5, tensor("weights", weights)) + field(5, tensor("bias", bias))
    graph += field(11, value("image", 1, 3, "height", "width")) + field(12, value("logits", 1, classes))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def export_demo_model(path: str, classes: int = 10) -> str:
    """Write the demo model; its digest, to be pinned."""
    data = demo_model(classes)
    with open(path, "wb") as f:
        f.write(data)
    return hashlib.sha256(data).hexdigest()


def load_encoder(data: bytes, magic: bytes | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """ONNX if the runtime takes the bytes, else a TorchScript archive where torch is installed, else a stub; IntegrityError
    for none of them."""
    try:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_BASIC
        model = ort.InferenceSession(data, sess_options=options, providers=["CPUExecutionProvider"])
        name = model.get_inputs()[0].name
        return lambda x: np.asarray(model.run(None, {name: x})[0], np.float32)
    except Exception:  # the runtime is missing or doesn't take it
        scripted = _torch_encoder(data) if data[:2] == b"PK" else None
        if scripted is not None:
            return scripted
        stub = LinearStub.load(data, magic) if magic else None
        if stub is None:
            raise IntegrityError("no runtime loads this encoder") from None
        return stub


def verified(path: str, pin: str) -> bytes:
    """A file's bytes, if their digest is the pinned one."""
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError as e:
        raise IntegrityError(f"no encoder at {path}") from e
    found = hashlib.sha256(data).hexdigest()
    if found != pin.lower():
        raise IntegrityError(f"the encoder's digest is {found}, not {pin}")
    return data


_loaded: dict[str, Callable] = {}


def _encoder(model: bytes | Callable, magic: bytes | None) -> Callable[[np.ndarray], np.ndarray]:
    if callable(model):
        return model
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = load_encoder(model, magic)
    return _loaded[key]


def features(
    images: DataFrame, reference: bytes | Callable, subject: bytes | Callable | None = None, tier: str = "T0", magic: bytes | None = None
) -> DataFrame:
    """(path, e_ref, e_sub) for images as read_images gives them; e_sub is null without a subject or below T1."""
    use = subject is not None and RANK[tier] >= RANK["T1"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = _encoder(reference, magic)
        sub = _encoder(subject, magic) if use else None
        vector = lambda f, x: np.asarray(f(x), np.float32).reshape(-1).tolist()
        for f in frames:
            xs = [preprocess(pixels(*r)) for r in zip(f["data"], f["width"], f["height"], f["channels"])]
            yield pd.DataFrame({"path": f["path"], "e_ref": [vector(ref, x) for x in xs], "e_sub": [vector(sub, x) if sub else None for x in xs]})

    return images.mapInPandas(run, "path string, e_ref array<float>, e_sub array<float>")


def infer(images: DataFrame, model: bytes, config: dict, magic: bytes | None = None) -> DataFrame:
    """(path, output_bytes, error): the model's output tensor of each image, as bytes, or why there is none."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(model, magic)
        for f in frames:
            outs, errors = [], []
            for r in zip(f["data"], f["width"], f["height"], f["channels"]):
                try:
                    outs.append(np.ascontiguousarray(encode(preprocess_with(pixels(*r), config))).tobytes())
                    errors.append(None)
                except Exception as e:  # one image that can't be run is a result of its own, not the end of the job
                    outs.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": f["path"], "output_bytes": outs, "error": errors})

    return images.mapInPandas(run, "path string, output_bytes binary, error string")
