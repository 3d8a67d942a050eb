"""The elements of an image file's header: tags, value kinds, character sets, sequences.

A header is read in pieces only as far as the last wanted element. Values come as text, several
as one backslash-separated text; sequences as JSON in the standard's JSON model.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Callable

# Fixed values of the file format: tags by keyword.
TAGS = {
    "MediaStorageSOPClassUID": 0x00020002, "MediaStorageSOPInstanceUID": 0x00020003, "TransferSyntaxUID": 0x00020010, "ImplementationClassUID": 0x00020012, "ImplementationVersionName": 0x00020013,
    "ImageType": 0x00080008, "SOPClassUID": 0x00080016, "SOPInstanceUID": 0x00080018, "StudyDate": 0x00080020, "SeriesDate": 0x00080021, "AcquisitionDate": 0x00080022, "ContentDate": 0x00080023,
    "StudyTime": 0x00080030, "SeriesTime": 0x00080031, "AcquisitionTime": 0x00080032, "ContentTime": 0x00080033, "Modality": 0x00080060, "ModalitiesInStudy": 0x00080061, "Manufacturer": 0x00080070,
    "InstitutionName": 0x00080080, "StationName": 0x00081010, "StudyDescription": 0x00081030, "SeriesDescription": 0x0008103E, "ManufacturerModelName": 0x00081090, "DerivationDescription": 0x00082111,
    "PatientName": 0x00100010, "PatientID": 0x00100020, "PatientBirthDate": 0x00100030, "PatientSex": 0x00100040, "PatientAge": 0x00101010, "PatientSize": 0x00101020, "PatientWeight": 0x00101030,
    "ContrastBolusAgent": 0x00180010, "BodyPartExamined": 0x00180015, "ScanningSequence": 0x00180020, "SequenceVariant": 0x00180021, "ScanOptions": 0x00180022, "MRAcquisitionType": 0x00180023,
    "SequenceName": 0x00180024, "AngioFlag": 0x00180025, "Radiopharmaceutical": 0x00180031, "SliceThickness": 0x00180050, "KVP": 0x00180060, "RepetitionTime": 0x00180080, "EchoTime": 0x00180081,
    "InversionTime": 0x00180082, "NumberOfAverages": 0x00180083, "ImagingFrequency": 0x00180084, "ImagedNucleus": 0x00180085, "EchoNumbers": 0x00180086, "MagneticFieldStrength": 0x00180087,
    "SpacingBetweenSlices": 0x00180088, "NumberOfPhaseEncodingSteps": 0x00180089, "DataCollectionDiameter": 0x00180090, "EchoTrainLength": 0x00180091, "PercentSampling": 0x00180093,
    "PercentPhaseFieldOfView": 0x00180094, "PixelBandwidth": 0x00180095, "ProtocolName": 0x00181030, "ContrastBolusRoute": 0x00181040, "ContrastBolusVolume": 0x00181041, "ContrastBolusStartTime": 0x00181042,
    "ContrastBolusTotalDose": 0x00181044, "ContrastFlowRate": 0x00181046, "ContrastFlowDuration": 0x00181047, "RadiopharmaceuticalRoute": 0x00181070, "RadiopharmaceuticalVolume": 0x00181071,
    "RadiopharmaceuticalStartTime": 0x00181072, "RadiopharmaceuticalStopTime": 0x00181073, "RadionuclideTotalDose": 0x00181074, "RadionuclideHalfLife": 0x00181075, "RadionuclidePositronFraction": 0x00181076,
    "ReconstructionDiameter": 0x00181100, "GantryDetectorTilt": 0x00181120, "TableHeight": 0x00181130, "RotationDirection": 0x00181140, "ExposureTime": 0x00181150, "XRayTubeCurrent": 0x00181151,
    "Exposure": 0x00181152, "FilterType": 0x00181160, "GeneratorPower": 0x00181170, "FocalSpots": 0x00181190, "ConvolutionKernel": 0x00181210, "ActualFrameDuration": 0x00181242, "ReceiveCoilName": 0x00181250,
    "TransmitCoilName": 0x00181251, "AcquisitionMatrix": 0x00181310, "FlipAngle": 0x00181314, "SAR": 0x00181316, "dBdt": 0x00181318, "B1rms": 0x00181320, "PatientPosition": 0x00185100,
    "PhaseContrast": 0x00189014, "ParallelReductionFactorInPlane": 0x00189069, "DiffusionDirectionality": 0x00189075, "ParallelAcquisitionTechnique": 0x00189078, "InversionTimes": 0x00189079,
    "DiffusionBValue": 0x00189087, "DiffusionGradientOrientation": 0x00189089, "RevolutionTime": 0x00189305, "SingleCollimationWidth": 0x00189306, "TotalCollimationWidth": 0x00189307, "TableSpeed": 0x00189309,
    "TableFeedPerRotation": 0x00189310, "SpiralPitchFactor": 0x00189311, "ExposureModulationType": 0x00189323, "CTDIvol": 0x00189345, "CTDIPhantomTypeCodeSequence": 0x00189346,
    "CalciumScoringMassFactorPatient": 0x00189351, "CalciumScoringMassFactorDevice": 0x00189352, "StudyInstanceUID": 0x0020000D, "SeriesInstanceUID": 0x0020000E, "SeriesNumber": 0x00200011,
    "AcquisitionNumber": 0x00200012, "InstanceNumber": 0x00200013, "ImagePositionPatient": 0x00200032, "ImageOrientationPatient": 0x00200037, "FrameOfReferenceUID": 0x00200052,
    "TemporalPositionIdentifier": 0x00200100, "NumberOfTemporalPositions": 0x00200105, "TemporalResolution": 0x00200110, "ImagesInAcquisition": 0x00201002, "SliceLocation": 0x00201041, "ImageComments": 0x00204000,
    "NumberOfFrames": 0x00280008, "Rows": 0x00280010, "Columns": 0x00280011, "PixelSpacing": 0x00280030, "BitsAllocated": 0x00280100, "BitsStored": 0x00280101, "HighBit": 0x00280102,
    "PixelRepresentation": 0x00280103, "WindowCenter": 0x00281050, "WindowWidth": 0x00281051, "RescaleIntercept": 0x00281052, "RescaleSlope": 0x00281053, "LossyImageCompression": 0x00282110,
    "StudyComments": 0x00324000, "NumberOfSlices": 0x00540081, "PatientGantryRelationshipCodeSequence": 0x00540414, "SliceProgressionDirection": 0x00540500, "SeriesType": 0x00541000, "Units": 0x00541001,
    "CountsSource": 0x00541002, "SUVType": 0x00541006, "RandomsCorrectionMethod": 0x00541100, "AttenuationCorrectionMethod": 0x00541101, "DecayCorrection": 0x00541102, "ReconstructionMethod": 0x00541103,
    "ScatterCorrectionMethod": 0x00541105, "FrameReferenceTime": 0x00541300, "DecayFactor": 0x00541321, "DoseCalibrationFactor": 0x00541322, "CountsIncluded": 0x00541400,
}
# Kinds of the wanted elements, and of codes, that a file without kinds does not tell; texts need none.
KINDS = {
    **{TAGS[k]: "US" for k in ("Rows", "Columns", "BitsAllocated", "BitsStored", "HighBit", "PixelRepresentation", "AcquisitionMatrix", "NumberOfSlices")},
    **{TAGS[k]: "FD" for k in ("InversionTimes", "DiffusionBValue", "DiffusionGradientOrientation", "ParallelReductionFactorInPlane", "RevolutionTime", "SingleCollimationWidth", "TotalCollimationWidth", "TableSpeed", "TableFeedPerRotation", "SpiralPitchFactor", "CTDIvol")},
    **{TAGS[k]: "FL" for k in ("B1rms", "CalciumScoringMassFactorDevice", "CalciumScoringMassFactorPatient")},
    **{TAGS[k]: "SQ" for k in ("CTDIPhantomTypeCodeSequence", "PatientGantryRelationshipCodeSequence")},
    **{TAGS[k]: "PN" for k in ("PatientName",)},
    0x00080100: "SH", 0x00080102: "SH", 0x00080103: "SH", 0x00080104: "LO",
}
_LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT", b"SV", b"UV"}
_NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "SV": "q", "UV": "Q"}
_BINARY = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
_WITHOUT_CHARSET = {"AE", "AS", "CS", "DA", "DS", "DT", "IS", "TM", "UI", "UR"}
_IMPLICIT, _DEFLATED, _BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
_CHARSET, _ITEM, _ITEM_END, _SEQUENCE_END, _UNDEFINED = 0x00080005, 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF
# Codecs of character sets, by their number, and of the escapes that switch between sets.
CHARSETS = {
    "6": "ascii", "13": "shift_jis", "100": "latin_1", "101": "iso8859_2", "109": "iso8859_3", "110": "iso8859_4", "126": "iso8859_7", "127": "iso8859_6", "138": "iso8859_8", "144": "iso8859_5",
    "148": "iso8859_9", "166": "iso8859_11", "192": "utf_8", "203": "iso8859_15", "87": "iso2022_jp", "159": "iso2022_jp_2", "149": "euc_kr", "58": "gb2312", "GB18030": "gb18030", "GBK": "gbk",
}
ESCAPES = {
    b"(B": "ascii", b"(J": "shift_jis", b")I": "shift_jis", b"-A": "latin_1", b"-B": "iso8859_2", b"-C": "iso8859_3", b"-D": "iso8859_4", b"-F": "iso8859_7", b"-G": "iso8859_6", b"-H": "iso8859_8",
    b"-L": "iso8859_5", b"-M": "iso8859_9", b"-T": "iso8859_11", b"$B": "iso2022_jp", b"$(D": "iso2022_jp_2", b"$)C": "euc_kr", b"$)A": "gb2312",
}


def codec_of(charset: str) -> str | None:
    """The codec of the first of the character sets that a header names; null if it names none."""
    name = charset.split("\\")[0].strip().upper()
    for prefix in ("ISO_IR ", "ISO 2022 IR ", "ISO_IR_", "ISO-IR ", "ISO IR "):
        name = name.removeprefix(prefix)
    return CHARSETS.get(name)


def decoded(raw: bytes, codec: str | None) -> str:
    """Text of a value. Without a known set it is UTF-8 if it can be, else Latin-1."""
    parts, out = raw.split(b"\x1b"), []
    for i, part in enumerate(parts):
        used, body = codec, part
        if i:
            escape = next((e for e in sorted(ESCAPES, key=len, reverse=True) if part.startswith(e)), b"")
            used, body = ESCAPES.get(escape, codec), part[len(escape) :]
            if escape in (b"$B", b"$(D"):
                body = b"\x1b" + part
        if used is None:
            try:
                out.append(body.decode("utf-8"))
            except UnicodeDecodeError:
                out.append(body.decode("latin_1"))
        else:
            out.append(body.decode(used, "replace"))
    return "".join(out)


class Header:
    """The elements of one file, from a function that reads a range of it."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size, self.at, self.buffer, self.start = read, size, 0, b"", 0
        self.order, self.implicit, self.codec = "<", False, None

    def take(self, n: int) -> bytes:
        if self.at < self.start or self.at + n > self.start + len(self.buffer):
            self.buffer, self.start = self.read(self.at, max(n, 1 << 16)), self.at
        out = self.buffer[self.at - self.start : self.at - self.start + n]
        if len(out) < n:
            raise ValueError("the header is cut off")
        self.at += n
        return out

    def peek(self, n: int) -> bytes:
        before, out = self.at, self.take(n)
        self.at = before
        return out

    def element(self) -> tuple[int, str, int]:
        group, number = struct.unpack(self.order + "HH", self.take(4))
        tag = group << 16 | number
        if group == 0xFFFE or self.implicit:
            return tag, KINDS.get(tag, "UN" if group == 0xFFFE else ""), struct.unpack(self.order + "I", self.take(4))[0]
        kind = self.take(2)
        if not (kind.isalpha() and kind.isupper()):
            raise ValueError(f"element {tag:08x} has no value kind")
        if kind in _LONG:
            self.take(2)
            return tag, kind.decode(), struct.unpack(self.order + "I", self.take(4))[0]
        return tag, kind.decode(), struct.unpack(self.order + "H", self.take(2))[0]

    def skip(self, length: int) -> None:
        """Past a value; one of undefined length holds items up to its delimiter."""
        depth = 1 if length == _UNDEFINED else 0
        if not depth:
            self.at += length
        while depth:
            tag, _, n = self.element()
            if tag in (_ITEM_END, _SEQUENCE_END):
                depth -= 1
            elif n == _UNDEFINED:
                depth += 1
            else:
                self.at += n

    def numbers(self, raw: bytes, kind: str) -> list:
        form = self.order + _NUMBERS[kind]
        n = struct.calcsize(form)
        values = [struct.unpack(form, raw[i : i + n])[0] for i in range(0, len(raw) - n + 1, n)]
        return [float(f"{v:.7g}") for v in values] if kind == "FL" else values

    def text(self, raw: bytes, kind: str) -> str:
        return decoded(raw, "latin_1" if kind in _WITHOUT_CHARSET else self.codec).rstrip("\0 ").lstrip(" ")

    def json_value(self, kind: str, length: int) -> dict:
        """An element in the JSON model."""
        if kind == "SQ" or length == _UNDEFINED:
            return {"vr": "SQ", "Value": self.items(length)} if length else {"vr": "SQ"}
        raw = self.take(length)
        if not raw:
            return {"vr": kind or "UN"}
        if kind in _NUMBERS:
            return {"vr": kind, "Value": self.numbers(raw, kind)}
        if kind in _BINARY or not kind:
            return {"vr": kind or "UN", "InlineBinary": base64.b64encode(raw).decode()}
        values = [v.strip() for v in self.text(raw, kind).split("\\")] if kind not in ("LT", "ST", "UT") else [self.text(raw, kind)]
        if kind == "PN":
            return {"vr": kind, "Value": [dict(zip(("Alphabetic", "Ideographic", "Phonetic"), v.split("="), strict=False)) for v in values]}
        if kind in ("IS", "DS"):
            number = int if kind == "IS" else float
            return {"vr": kind, "Value": [number(v) if v else None for v in values]}
        return {"vr": kind, "Value": values}

    def items(self, length: int) -> list[dict]:
        """The items of a sequence, each an object of its elements by tag; sequences may lie in sequences."""
        end = float("inf") if length == _UNDEFINED else self.at + length
        out = []
        while self.at < end:
            tag, _, n = self.element()
            if tag == _SEQUENCE_END:
                break
            if tag != _ITEM:
                raise ValueError(f"a sequence holds element {tag:08x}")
            stop, item, outer = (float("inf") if n == _UNDEFINED else self.at + n), {}, self.codec
            while self.at < stop:
                tag, kind, size = self.element()
                if tag == _ITEM_END:
                    break
                if tag == _CHARSET and size != _UNDEFINED:
                    raw = self.take(size)
                    self.codec = codec_of(raw.decode("latin_1").strip("\0 "))
                    item[f"{tag:08X}"] = {"vr": "CS", "Value": self.text(raw, "CS").split("\\")}
                else:
                    item[f"{tag:08X}"] = self.json_value(kind, size)
            self.codec = outer
            out.append(item)
        return out

    def _inflated(self) -> None:
        """From here on the file is one deflated stream; it is inflated as far as it is read."""
        base, raw, held, inflate, begun = self.at, self.read, bytearray(), zlib.decompressobj(-15), self.at
        size = self.size

        def read(at: int, n: int) -> bytes:
            nonlocal base
            while len(held) < at - begun + n and base < size and not inflate.eof:
                piece = raw(base, 1 << 16)
                base += len(piece)
                if not piece:
                    break
                held.extend(inflate.decompress(piece))
            return bytes(held[at - begun : at - begun + n])

        self.read, self.buffer, self.start, self.size = read, b"", self.at, float("inf")

    def _begin(self) -> None:
        """To the first element: behind a preamble, or at once in a file without one."""
        if self.size >= 132:
            self.at = 128
            if self.take(4) == b"DICM":
                return
        self.at = 0
        first = self.peek(8) if self.size >= 8 else b"\0" * 8
        group, number = struct.unpack("<HH", first[:4])
        explicit = first[4:6].isalpha() and first[4:6].isupper()
        if group not in (0x0002, 0x0008) or number > 0x0100 or not (explicit or struct.unpack("<I", first[4:])[0] < 1 << 16):
            raise ValueError("no image header")
        self.implicit = not explicit

    def values(self, wanted: set[int]) -> dict[int, str]:
        """tag -> text of the wanted elements that the header has."""
        self._begin()
        found, last, syntax, in_meta, implicit = {}, max(wanted, default=0), "", True, self.implicit
        while self.at < self.size:
            try:
                group = struct.unpack(self.order + "H", self.peek(2))[0]
            except ValueError:
                if self.at > 132 and self.size == float("inf"):
                    break  # the end of a deflated stream
                raise
            if in_meta and group != 0x0002:
                in_meta = False
                if syntax:
                    if syntax == _DEFLATED:
                        self._inflated()
                    self.order, implicit = (">" if syntax == _BIG else "<"), syntax == _IMPLICIT
                self.implicit = implicit
                continue
            if in_meta:
                self.implicit = False if syntax or not implicit else implicit
            if not in_meta and group << 16 | struct.unpack(self.order + "HH", self.peek(4))[1] > last:
                break
            tag, kind, length = self.element()
            if tag == _CHARSET and length != _UNDEFINED:
                self.codec = codec_of(self.take(length).decode("latin_1").strip("\0 "))
            elif tag in wanted or tag == TAGS["TransferSyntaxUID"]:
                if kind == "SQ" or length == _UNDEFINED:
                    found[tag] = json.dumps(self.items(length), ensure_ascii=False)
                    continue
                raw = self.take(length)
                found[tag] = "\\".join(map(str, self.numbers(raw, kind))) if kind in _NUMBERS else self.text(raw, kind)
                syntax = found[tag] if tag == TAGS["TransferSyntaxUID"] else syntax
            else:
                self.skip(length)
        return {t: v for t, v in found.items() if t in wanted}
