"""Image headers of listed files, and what ingest makes of them.

The paths stay a table: tasks open the files of their rows and read the elements that are asked
for and nothing behind the last of them. A file that is no image gives a row with `error`.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import dicom as D
from stackloom.sources.elements import TAGS, Header

# What is let in.
MODALITIES = ("MR", "CT", "PT", "PET")
SOP_CLASSES = tuple(f"1.2.840.10008.5.1.4.1.1.{x}" for x in ("2", "2.1", "2.2", "4", "4.1", "4.2", "4.4", "128", "128.1"))


def _reader(keywords: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        wanted = {TAGS[k] for k in keywords}
        names, rows = ["path", *keywords, "error"], []
        schema = pa.schema([(n, pa.string()) for n in names])
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
                    with system.open_input_file(inner) as raw:

                        def piece(at: int, n: int, raw=raw) -> bytes:
                            raw.seek(at)
                            return raw.read(n)

                        found = Header(piece, size).values(wanted)
                    rows.append((path, *(found.get(TAGS[k]) for k in keywords), None))
                except (ValueError, OSError, OverflowError, struct.error, zlib.error, RecursionError) as error:
                    rows.append((path, *(None for _ in keywords), str(error) or type(error).__name__))
                if len(rows) == 512:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                    rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return read


def read_headers(spark: SparkSession, files: DataFrame, keywords: list[str], files_per_task: int = 2000) -> DataFrame:
    """(path, a text column for each keyword, error) for files(path, bytes).

    A header costs a file's opening and a few pieces of it, whatever the file's size, so files are dealt
    out evenly, files_per_task to a task; their paths never gather anywhere. Several values are one text with
    backslashes, sequences are JSON. Keywords without a tag are columns of nulls."""
    known = [k for k in keywords if k in TAGS]
    listed = files.select("path", F.col("bytes").cast("long").alias("bytes"))
    tasks = max(1, -(-listed.count() // files_per_task))
    schema = "path string, " + "".join(f"`{k}` string, " for k in known) + "error string"
    found = listed.repartition(tasks).mapInArrow(_reader(known), schema)
    return found.select("path", *(F.col(k) if k in known else F.lit(None).cast("string").alias(k) for k in keywords), "error")


# Column -> (keyword, converter): what ingest makes of a header.
PROJECTION = {
    "study_uid": ("StudyInstanceUID", None), "series_uid": ("SeriesInstanceUID", None), "sop_uid": ("SOPInstanceUID", None), "sop_class_uid": ("SOPClassUID", None),
    "patient_id": ("PatientID", None), "patient_name": ("PatientName", None), "modality": ("Modality", None), "study_date": ("StudyDate", D.to_date), "image_type": ("ImageType", None),
    "te": ("EchoTime", D.to_float), "tr": ("RepetitionTime", D.to_float), "ti": ("InversionTime", D.to_float), "fa": ("FlipAngle", D.to_float), "rows": ("Rows", D.to_int), "columns": ("Columns", D.to_int),
    "instance_number": ("InstanceNumber", D.to_int), "series_description": ("SeriesDescription", None), "manufacturer": ("Manufacturer", None),
}
_DATE, _TIME, _INT, _FLOAT = D.to_date, D.dicom_time, D.to_int, D.to_float
# The columns of the tables of an archive, each (keyword, converter); keywords without a tag stay null.
TABLES = {
    "study": {
        "study_date": ("StudyDate", _DATE), "study_time": ("StudyTime", _TIME), "study_description": ("StudyDescription", None), "study_comments": ("StudyComments", None), "modality": ("ModalitiesInStudy", None),
        "manufacturer": ("Manufacturer", None), "manufacturer_model_name": ("ManufacturerModelName", None), "station_name": ("StationName", None), "institution_name": ("InstitutionName", None),
    },
    "series": {
        "frame_of_reference_uid": ("FrameOfReferenceUID", None), "implementation_class_uid": ("ImplementationClassUID", None), "media_storage_sop_instance_uid": ("MediaStorageSOPInstanceUID", None),
        "sop_class_uid": ("SOPClassUID", None), "implementation_version_name": ("ImplementationVersionName", None), "sequence_name": ("SequenceName", None), "protocol_name": ("ProtocolName", None),
        "series_date": ("SeriesDate", _DATE), "series_time": ("SeriesTime", _TIME), "series_description": ("SeriesDescription", None), "body_part_examined": ("BodyPartExamined", None),
        "scanning_sequence": ("ScanningSequence", None), "sequence_variant": ("SequenceVariant", None), "scan_options": ("ScanOptions", None), "series_comments": ("SeriesComments", None), "image_type": ("ImageType", None),
        "slice_thickness": ("SliceThickness", _FLOAT), "spacing_between_slices": ("SpacingBetweenSlices", _FLOAT), "images_in_acquisition": ("ImagesInAcquisition", None),
        "image_orientation_patient": ("ImageOrientationPatient", None), "image_position_patient": ("ImagePositionPatient", None), "patient_position": ("PatientPosition", None),
        "contrast_bolus_agent": ("ContrastBolusAgent", None), "contrast_bolus_route": ("ContrastBolusRoute", None), "contrast_bolus_total_dose": ("ContrastBolusTotalDose", _FLOAT),
        "contrast_bolus_start_time": ("ContrastBolusStartTime", _TIME), "contrast_bolus_volume": ("ContrastBolusVolume", _FLOAT), "contrast_flow_rate": ("ContrastFlowRate", _FLOAT),
        "contrast_flow_duration": ("ContrastFlowDuration", _FLOAT),
    },
    "instance": {
        "instance_number": ("InstanceNumber", _INT), "acquisition_number": ("AcquisitionNumber", _INT), "acquisition_date": ("AcquisitionDate", _DATE), "acquisition_time": ("AcquisitionTime", _TIME),
        "content_date": ("ContentDate", _DATE), "content_time": ("ContentTime", _TIME), "slice_location": ("SliceLocation", _FLOAT), "pixel_spacing": ("PixelSpacing", None), "rows": ("Rows", _INT),
        "columns": ("Columns", _INT), "bits_allocated": ("BitsAllocated", _INT), "bits_stored": ("BitsStored", _INT), "high_bit": ("HighBit", _INT), "pixel_representation": ("PixelRepresentation", _INT),
        "window_center": ("WindowCenter", None), "window_width": ("WindowWidth", None), "rescale_intercept": ("RescaleIntercept", _FLOAT), "rescale_slope": ("RescaleSlope", _FLOAT),
        "number_of_frames": ("NumberOfFrames", _INT), "lossy_image_compression": ("LossyImageCompression", None), "derivation_description": ("DerivationDescription", None), "image_comments": ("ImageComments", None),
        "transfer_syntax_uid": ("TransferSyntaxUID", None), "inversion_time": ("InversionTime", _FLOAT), "echo_time": ("EchoTime", _FLOAT), "echo_numbers": ("EchoNumbers", None),
        "echo_train_length": ("EchoTrainLength", _INT), "repetition_time": ("RepetitionTime", _FLOAT), "flip_angle": ("FlipAngle", _FLOAT), "receive_coil_name": ("ReceiveCoilName", None),
        "image_orientation_patient": ("ImageOrientationPatient", None), "image_type": ("ImageType", None), "xray_exposure": ("Exposure", _FLOAT), "kvp": ("KVP", _FLOAT), "tube_current": ("XRayTubeCurrent", _FLOAT),
        "pet_bed_index": ("NumberOfSlices", _INT), "pet_frame_type": ("SeriesType", None),
    },
    "mri_series": {
        "mr_acquisition_type": ("MRAcquisitionType", None), "angio_flag": ("AngioFlag", None), "repetition_time": ("RepetitionTime", _FLOAT), "echo_time": ("EchoTime", _FLOAT), "inversion_time": ("InversionTime", _FLOAT),
        "inversion_times": ("InversionTimes", None), "flip_angle": ("FlipAngle", _FLOAT), "phase_contrast": ("PhaseContrast", None), "number_of_averages": ("NumberOfAverages", _FLOAT),
        "imaging_frequency": ("ImagingFrequency", _FLOAT), "imaged_nucleus": ("ImagedNucleus", None), "echo_numbers": ("EchoNumbers", None), "magnetic_field_strength": ("MagneticFieldStrength", _FLOAT),
        "number_of_phase_encoding_steps": ("NumberOfPhaseEncodingSteps", None), "echo_train_length": ("EchoTrainLength", _INT), "percent_sampling": ("PercentSampling", _FLOAT),
        "percent_phase_field_of_view": ("PercentPhaseFieldOfView", _FLOAT), "pixel_bandwidth": ("PixelBandwidth", None), "receive_coil_name": ("ReceiveCoilName", None), "transmit_coil_name": ("TransmitCoilName", None),
        "acquisition_matrix": ("AcquisitionMatrix", None), "phase_encoding_direction": ("PhaseEncodingDirection", None), "sar": ("SAR", _FLOAT), "dbdt": ("dBdt", None), "b1rms": ("B1rms", None),
        "temporal_position_identifier": ("TemporalPositionIdentifier", _INT), "number_of_temporal_positions": ("NumberOfTemporalPositions", _INT), "temporal_resolution": ("TemporalResolution", None),
        "diffusion_b_value": ("DiffusionBValue", None), "diffusion_gradient_orientation": ("DiffusionGradientOrientation", None), "diffusion_directionality": ("DiffusionDirectionality", None),
        "parallel_acquisition_technique": ("ParallelAcquisitionTechnique", None), "parallel_reduction_factor_in_plane": ("ParallelReductionFactorInPlane", None),
    },
    "ct_series": {
        "kvp": ("KVP", _FLOAT), "data_collection_diameter": ("DataCollectionDiameter", _FLOAT), "reconstruction_diameter": ("ReconstructionDiameter", _FLOAT), "gantry_detector_tilt": ("GantryDetectorTilt", _FLOAT),
        "table_height": ("TableHeight", _FLOAT), "rotation_direction": ("RotationDirection", None), "exposure_time": ("ExposureTime", _FLOAT), "x_ray_tube_current": ("XRayTubeCurrent", _FLOAT), "exposure": ("Exposure", _FLOAT),
        "filter_type": ("FilterType", None), "generator_power": ("GeneratorPower", _FLOAT), "focal_spots": ("FocalSpots", None), "convolution_kernel": ("ConvolutionKernel", None), "revolution_time": ("RevolutionTime", _FLOAT),
        "single_collimation_width": ("SingleCollimationWidth", _FLOAT), "total_collimation_width": ("TotalCollimationWidth", _FLOAT), "table_speed": ("TableSpeed", _FLOAT),
        "table_feed_per_rotation": ("TableFeedPerRotation", _FLOAT), "spiral_pitch_factor": ("SpiralPitchFactor", _FLOAT), "exposure_modulation_type": ("ExposureModulationType", None), "ctdi_vol": ("CTDIvol", _FLOAT),
        "ctdi_phantom_type_code_sequence": ("CTDIPhantomTypeCodeSequence", None), "calcium_scoring_mass_factor_device": ("CalciumScoringMassFactorDevice", _FLOAT),
        "calcium_scoring_mass_factor_patient": ("CalciumScoringMassFactorPatient", _FLOAT),
    },
    "pet_series": {
        "radiopharmaceutical": ("Radiopharmaceutical", None), "radionuclide_total_dose": ("RadionuclideTotalDose", _FLOAT), "radionuclide_half_life": ("RadionuclideHalfLife", _FLOAT),
        "radionuclide_positron_fraction": ("RadionuclidePositronFraction", _FLOAT), "radiopharmaceutical_start_time": ("RadiopharmaceuticalStartTime", _TIME),
        "radiopharmaceutical_stop_time": ("RadiopharmaceuticalStopTime", _TIME), "radiopharmaceutical_volume": ("RadiopharmaceuticalVolume", _FLOAT), "radiopharmaceutical_route": ("RadiopharmaceuticalRoute", None),
        "decay_correction": ("DecayCorrection", None), "decay_factor": ("DecayFactor", _FLOAT), "reconstruction_method": ("ReconstructionMethod", None), "scatter_correction_method": ("ScatterCorrectionMethod", None),
        "attenuation_correction_method": ("AttenuationCorrectionMethod", None), "randoms_correction_method": ("RandomsCorrectionMethod", None), "dose_calibration_factor": ("DoseCalibrationFactor", _FLOAT),
        "activity_concentration_scale": ("ActivityConcentrationScale", _FLOAT), "suv_type": ("SUVType", None), "suvbw": ("SUVbw", _FLOAT), "suvlbm": ("SUVlbm", _FLOAT), "suvbsa": ("SUVbsa", _FLOAT),
        "counts_source": ("CountsSource", None), "units": ("Units", None), "frame_reference_time": ("FrameReferenceTime", _FLOAT), "actual_frame_duration": ("ActualFrameDuration", _FLOAT),
        "patient_gantry_relationship_code": ("PatientGantryRelationshipCodeSequence", None), "slice_progression_direction": ("SliceProgressionDirection", None), "series_type": ("SeriesType", None),
        "units_type": ("Units", None), "counts_included": ("CountsIncluded", None),
    },
}
#: Elements of the file's meta group that stand in for missing ones.
FALLBACKS = {"SOPClassUID": "MediaStorageSOPClassUID", "SOPInstanceUID": "MediaStorageSOPInstanceUID"}


def keywords_of(*projections: dict) -> list[str]:
    """The keywords that projections need, fallbacks included, each once."""
    needed = [k for p in projections for k, _ in p.values()]
    return list(dict.fromkeys([*needed, *(FALLBACKS[k] for k in needed if k in FALLBACKS)]))


def projected(headers: DataFrame, projection: dict = PROJECTION) -> DataFrame:
    """path and the projection's columns; empty texts are null, a missing element is taken from the
    file's meta group where that has it, and a keyword that headers lack gives nulls."""
    columns = []
    for name, (keyword, converter) in projection.items():
        given = [F.nullif(F.trim(F.col(k)), F.lit("")) for k in (keyword, FALLBACKS.get(keyword)) if k in headers.columns]
        raw = F.coalesce(*given) if given else F.lit(None).cast("string")
        columns.append((converter(raw) if converter else raw).alias(name))
    return headers.select("path", *columns)


def normal_modality(modality: Column) -> Column:
    """Trimmed and upper-case; null if it is not one that is let in."""
    upper = F.upper(F.trim(modality))
    return F.when(upper.isin(*MODALITIES), upper)


def let_in(rows: DataFrame) -> DataFrame:
    """The rows that ingest takes: all identifiers there, a known SOP class and modality."""
    whole = rows.filter(" and ".join(f"coalesce({c}, '') <> ''" for c in ("study_uid", "series_uid", "sop_uid", "sop_class_uid")))
    return whole.filter(F.col("sop_class_uid").isin(*SOP_CLASSES)).withColumn("modality", normal_modality(F.col("modality"))).filter("modality is not null")
