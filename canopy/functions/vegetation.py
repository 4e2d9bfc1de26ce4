"""Satellite vegetation indices as columns over band values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from canopy.functions.spectral import to_uint8

# The published Sentinel-2 biophysical processor network for leaf
# area index. Per input: lower bound, upper bound, weights to the five neurons.
LAI_INPUTS = {
    "b03": (0.0, 0.253061520471542,
            (-0.023406878966470, -0.132555480856684, 0.086015977724868, -0.109366593670404, -0.089939416159969)),
    "b04": (0.0, 0.290393577911328,
            (0.921655164636366, -0.139574837333540, 0.616648776881434, -0.071046262972729, 0.175395483106147)),
    "b05": (0.0, 0.305398915248555,
            (0.135576544080099, -1.014606016898920, 0.678003876446556, 0.064582411478320, -0.081847329172620)),
    "b06": (0.006637972542253, 0.608900395797889,
            (-1.938331472397950, -1.330890038649270, 0.141102398644968, 2.906325236823160, 2.219895367487790)),
    "b07": (0.013972727018939, 0.753827384322927,
            (-3.342495816122680, 0.031730624503341, -0.096682206883546, -0.673873108979163, 1.713873975136850)),
    "b8a": (0.026690138082061, 0.782011770669178,
            (0.902277648009576, -1.433583541317050, -1.128832638862200, -3.838051868280840, 0.713069186099534)),
    "b11": (0.016388074192258, 0.493761397883092,
            (0.205363538258614, -0.959637898574699, 0.302189102741375, 1.695979344531530, 0.138970813499201)),
    "b12": (0.0, 0.493025984460231,
            (-0.040607844721716, 1.133115706551000, 0.434494937299725, 0.046950296081713, -0.060771761518025)),
    "view_zenith": (0.918595400582046, 1.0,
                    (-0.083196409727092, 0.216603876541632, -0.021903699490589, -0.049709652688365, 0.124263341255473)),
    "sun_zenith": (0.342022871159208, 0.936206429175402,
                   (0.260029270773809, 0.410652303762839, -0.228492476802263, 0.021829545430994, 0.210086140404351)),
    "relative_azimuth": (-1.0, 1.0,
                         (0.284761567218845, 0.064760155543506, -0.039460537589826, 0.057483827104091, -0.183878138700341)),
}
LAI_BIAS = (4.96238030555279, 1.416008443981500, 1.075897047213310, 1.533988264655420, 3.024115930757230)
LAI_OUTPUT_BIAS = 1.096963107077220
LAI_OUTPUT_WEIGHTS = (-1.500135489728730, -0.096283269121503, -0.194935930577094, -0.352305895755591, 0.075107415847473)
LAI_RANGE = (0.000319182538301, 14.4675094548151)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, lo: float, hi: float) -> Column:
    # greatest/least skip NULLs, so keep NULL explicitly.
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def s2_ndvi(b04="b04", b08="b08", scaled: bool = False) -> Column:
    red, nir = _col(b04), _col(b08)
    v = clip(F.try_divide(nir - red, nir + red), 0, 1)
    return to_uint8(v) if scaled else v


def s2_nbr(b08="b08", b12="b12", scaled: bool = False) -> Column:
    nir, swir = _col(b08), _col(b12)
    v = clip(F.try_divide(nir - swir, nir + swir), 0, 1)
    return to_uint8(v) if scaled else v


def s2_msi(b08="b08", b11="b11", scaled: bool = False) -> Column:
    v = clip(F.try_divide(_col(b11), _col(b08)), 0, 3)
    return F.floor(v * (255 / 3)).cast("int") if scaled else v


def _lai_inputs(zenith, azimuth, bands: dict) -> tuple[dict[str, Column], Column]:
    """The eleven network inputs, never NULL, and whether the row has them all."""
    inputs = {b: _col(bands.get(b, b)) for b in list(LAI_INPUTS)[:8]} | {"zenith": _col(zenith), "azimuth": _col(azimuth)}
    known = {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in inputs.items()}
    rad = math.pi / 180
    zen, azi = known["zenith"], known["azimuth"]
    raw = {b: known[b] / 10000 for b in list(LAI_INPUTS)[:8]}
    raw["view_zenith"] = F.cos(zen * rad)
    raw["sun_zenith"] = F.cos(azi * rad)
    raw["relative_azimuth"] = F.cos((zen - azi) * rad)
    present = inputs["b03"] != 0
    for c in list(inputs.values())[1:]:
        present = present & c.isNotNull()
    return raw, present


def _lai_network(raw: dict[str, Column]) -> Column:
    out = F.lit(LAI_OUTPUT_BIAS)
    for j in range(5):
        # Scaling to -1..1 is linear, so it folds into the neuron's weights and bias.
        neuron = F.lit(LAI_BIAS[j] - sum(w[j] * (2 * lo / (hi - lo) + 1) for lo, hi, w in LAI_INPUTS.values()))
        for k, (lo, hi, w) in LAI_INPUTS.items():
            neuron = neuron + raw[k] * (2 * w[j] / (hi - lo))
        out = out + F.tanh(neuron) * LAI_OUTPUT_WEIGHTS[j]
    lo, hi = LAI_RANGE
    return F.least(F.greatest((0.5 * (out + 1) * (hi - lo) + lo) / 3, F.lit(0.0)), F.lit(3.0))


def _lai_scaled(value: Column, scaled: bool) -> Column:
    return F.floor(value * (255 / 3)).cast("int") if scaled else value


def s2_lai(zenith="zenith", azimuth="azimuth", scaled: bool = False, **bands) -> Column:
    """Leaf area index / 3, clipped to 0..3; NULL where b03 is 0 or an input is missing.

    The two angle inputs are used as the reference uses them: zenith in the
    view-zenith slot and azimuth in the sun-zenith slot.
    """
    raw, present = _lai_inputs(zenith, azimuth, bands)
    return _lai_scaled(F.when(present, _lai_network(raw)), scaled)


def with_lai(
    pixels: DataFrame, out: str = "lai", zenith="zenith", azimuth="azimuth", scaled: bool = False, **bands
) -> DataFrame:
    """The same as a column ``out``, in two steps: inputs, then the network.

    As one expression next to many other columns the generated method grows past
    what the JVM compiles; two projections give two short methods.
    """
    raw, present = _lai_inputs(zenith, azimuth, bands)
    fed = pixels.select("*", *[c.alias(f"__{k}") for k, c in raw.items()], present.alias("__present"))
    value = F.when(F.col("__present"), _lai_network({k: F.col(f"__{k}") for k in raw}))
    return fed.withColumn(out, _lai_scaled(value, scaled)).drop(*[f"__{k}" for k in raw], "__present")
