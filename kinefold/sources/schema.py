"""Schemas of the annotation tables; sessions are folders <root>/<split>/<session>."""

PREFIX = "root string, split string, session_id string"
TABLES = {
    "groups": "group_id string, n_frames int, fps float, source_video string, source_frame_start int, source_frame_step int, notes string",
    "keypoints": "group_id string, frame int, animal_id string, camera string, bodypart string, status string, x float, y float, score float, score_logit float",
    "points3d": "group_id string, frame int, animal_id string, bodypart string, status string, x float, y float, z float, score float, score_logit float",
    "instances": "group_id string, frame int, animal_id string, camera string, x0 float, y0 float, x1 float, y1 float, status string, notes string, score float, box_agree float",
    "regions": "group_id string, frame int, camera string, x0 float, y0 float, x1 float, y1 float, status string",
    "extrinsics": "group_id string, frame int, camera string, ext array<double>",
    "windows": "group_id string, animal_id string, camera string, window int, frame int, outcome string, x0 float, y0 float, x1 float, y1 float, rx0 float, ry0 float, rx1 float, ry1 float, box_prompt_cams int",
}
SESSION = "mode string, units string, labels string, names array<string>, skeleton array<array<string>>, flip_pairs array<array<string>>, provenance map<string,string>, assoc_res_max_px double"
CAMERA = "name string, cam_ix int, width int, height int, matrix array<double>, distortions array<double>, rvec array<double>, tvec array<double>, fisheye boolean, moving boolean, calibrated boolean, offset_x double, offset_y double"
# What a manifest may say.
MODES, LABELS = ("2d", "3d"), ("annotated", "tracked")
ASSOCIATION_PX = 30.0
