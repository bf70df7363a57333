"""Record schemas; never inferred."""

POINT = "struct<x:double,y:double>"
BOX = "struct<min_x:double,max_y:double,max_x:double,min_y:double>"
SHAPE = (
    f"struct<type:string,points:array<{POINT}>,center:{POINT},major_axis:double,minor_axis:double,"
    "rotation:double,initial_radius:double,growth_rate:double,sin_params:array<double>,max_theta:double,"
    "radius:double,start_angle:double,end_angle:double,outer_radius:double,inner_radius:double,"
    "num_points:int,special_info:string,fill_mode:string>"
)
SCENES = f"image_id long, shapes array<{SHAPE}>, relations array<struct<head:int,tail:int,relation:string>>"
QUESTIONS = (
    "perspective string, image_id long, question_id int, question string, choices array<string>, answer string"
)
PREDICTIONS = QUESTIONS + ", model string, response string, pred string"
CAPTIONS = "id long, image string, input string, output string"
TURNS = "array<struct<from:string,value:string>>"
CONVERSATIONS = f"id string, image string, conversations {TURNS}"
CATALOGUE = (
    "map<string,struct<desc:string,images:array<struct<image:string,section_type:string,"
    "specimen_type:string,`pixel/mm`:double>>>>"
)
EVAL_PAIRS = "img string, question string, output string, reference string"
FEATURES = "image string, side string, feature string, text string"
RATINGS = "image string, feature string, rating double, reason string"
REVIEWS = "question_id long, category string, content string, tuple array<double>"
