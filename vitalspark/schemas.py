"""Row types of the engine's tables, stated and never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


def _of(ddl: str) -> str:
    return " ".join(ddl.split())


TIMING = "struct<capture_to_data_url_ms:double,request_round_trip_ms:double,response_parse_ms:double,total_browser_sample_ms:double,backend_total_request_processing_ms:double,backend_face_debug_total_ms:double,backend_decode_ms:double,http_status:int>"
ROI = "struct<r:double,g:double,b:double,quality_status:string>"
SAMPLE = f"struct<t_s:double,face_detected:boolean,roi_quality_overall:string,acquisition_timing:{TIMING},rois:map<string,{ROI}>>"
PAYLOAD = f"samples array<{SAMPLE}>, window_seconds double"

MANIFEST = _of("""dataset string, subject_key string, split string, subject_id string, recording_id string, start_frame int, end_frame int, start_s double, end_s double, source_fps double,
 window_seconds double, stride_seconds double, model_buffer_seconds double, target_frames int, recording_sqi_ensemble double, dataset_sqi_gate double, target_hr_mean double, target_hr_median double,
 target_hr_min double, target_hr_max double, target_hr_range double, target_nan_frac double, label_stability_bucket string, signal_window_ok boolean, signal_window_reason string, window_role string,
 include_in_finetune boolean, include_in_eval boolean, reason string""")

PREDICTION = _of("""dataset string, subject_key string, split string, window_role string, subject_id string, recording_id string, start_frame int, end_frame int, start_s double, end_s double, source_fps double,
 preprocessing_mode string, target_hr_mean double, target_hr_median double, target_hr_range double, label_stability_bucket string, manifest_reason string, preprocessing_status string, preprocessing_error string,
 model_buffer_seconds double, simulated_fps double, sample_count int, window_sample_count int, model_hr double, model_abs_error double, spectral_consensus_hr double, spectral_abs_error double, spectral_spread_bpm double,
 pos_bpm double, pos_sqi double, pos_corr_vs_stored double, chrom_bpm double, chrom_sqi double, chrom_corr_vs_stored double, green_bpm double, green_sqi double, green_corr_vs_stored double""")

RECORDING = _of("""subject_id string, activity_id string, activity_name string, camera string, dataset string, reference_type string, n_frames int, fps double, hr_mean double, rmssd_ms double, sdnn_ms double, pnn50_pct double,
 ecg_sqi double, sqi_pos double, sqi_chrom double, sqi_green double, sqi_ensemble double, no_face_pct double, rppg_pos array<float>, rppg_chrom array<float>, rppg_green array<float>, rppg_ensemble array<float>,
 reference_signal array<float>, hr_continuous array<float>, rr_intervals array<float>, ensemble_weights array<float>, roi_rgb array<array<array<float>>>, biomarkers map<string,struct<value:double,tier:string,valid:boolean>>""")

LOGS = {
    "ecg_fitness": "subject_id string, activity_id string, status string, skip_reason string, hr_mean double, ecg_sqi double, rppg_sqi double, n_frames int, no_face_pct double",
    "ubfc_phys": "subject_id string, task string, task_name string, status string, skip_reason string, hr_mean double, rppg_sqi double, bvp_sqi double, n_frames int, no_face_pct double",
    "ubfc_rppg": "subject_id string, activity_id string, status string, skip_reason string, hr_mean double, rppg_sqi double, n_frames int, no_face_pct double",
}


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def assert_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself, if it has the columns; KeyError names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; there are {df.columns}")
    return df
