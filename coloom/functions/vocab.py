"""Fixed vocabularies of the case-report language.

The values below are fixed: results depend on them literally.  Every extractor
takes them as parameters, so another corpus brings its own.
"""

from __future__ import annotations

import datetime as dt

# -- fixed values: dates ------------------------------------------------------
LOCKDOWN_DATE = dt.date(2020, 1, 23)
FESTIVAL_DATE = dt.date(2020, 1, 24)
DEFAULT_YEAR = 2020

# -- fixed values: record and sentence delimiters -----------------------------
CASE_MARKER = "第[0-9０-９]+号确诊病例"
TERMINATORS = "。；;"

# -- fixed values: event types ------------------------------------------------
EVENT_TYPES = {
    1: "出行",
    2: "就餐",
    3: "购物",
    4: "就诊",
    5: "居家",
    6: "聚会",
    7: "工作",
    8: "交通",
    9: "其他",
}

# Cascade order: the first class with a keyword in the sentence wins, else 9.
EVENT_CASCADE = [
    (4, ["医院", "就诊", "发热门诊", "隔离治疗", "住院", "门诊"]),
    (8, ["高铁", "火车", "航班", "飞机", "自驾", "出租车", "滴滴", "地铁", "城轨", "大巴", "客车"]),
    (3, ["超市", "商场", "购物中心", "永辉", "沃尔玛", "盒马"]),
    (2, ["聚餐", "年夜饭", "餐厅", "饭店", "餐馆", "酒店", "包间"]),
    (6, ["聚会", "朋友", "亲戚", "来访", "做客"]),
    (7, ["公司", "上班", "工作", "工厂", "办公室"]),
    (5, ["家中", "家里", "居家", "住所", "住处"]),
    (1, ["出发", "到达", "前往", "回到", "离沪", "离汉"]),
]
EVENT_OTHER = 9

# -- fixed values: venue keywords of the event extractor ----------------------
VENUES = {
    "医院": ["医院", "诊所", "卫生院", "门诊", "发热门诊", "隔离", "定点", "住院", "ICU"],
    "餐厅": ["餐厅", "饭店", "餐馆", "酒店", "年夜饭", "聚餐", "包间", "火锅店", "酒楼", "食堂", "咖啡厅"],
    "超市": ["超市", "商场", "购物中心", "永辉", "沃尔玛", "华润", "盒马", "便利店", "商店"],
    "交通工具": ["高铁", "火车", "航班", "飞机", "自驾", "出租车", "滴滴", "地铁", "城轨", "大巴", "客车",
             "私家车", "顺风车", "动车", "高铁站", "机场"],
    "家庭": ["家中", "家里", "居家", "住所", "住处", "回家", "住所地"],
    "工作场所": ["公司", "单位", "上班", "工作", "工厂", "写字楼", "办公室", "车间"],
    "酒店": ["酒店", "宾馆", "民宿", "旅馆", "招待所"],
    "公共场所": ["广场", "公园", "景区", "景点", "超市", "农贸市场", "菜市场", "步行街"],
    "学校": ["学校", "幼儿园", "小学", "中学", "大学", "培训机构", "培训班"],
    "药店": ["药店", "药房", "买药"],
}

# -- fixed values: venue keywords of the statistics pass ----------------------
STAT_VENUES = {
    "医院": ["医院", "诊所", "卫生院", "门诊", "发热门诊", "隔离", "定点"],
    "餐厅": ["餐厅", "饭店", "餐馆", "酒店", "年夜饭", "聚餐", "包间", "火锅店", "酒楼"],
    "超市": ["超市", "商场", "购物中心", "永辉", "沃尔玛", "华润", "盒马"],
    "交通工具": ["高铁", "火车", "航班", "飞机", "自驾", "出租车", "滴滴", "地铁", "城轨", "大巴", "客车",
             "私家车", "顺风车"],
    "家庭": ["家中", "家里", "居家", "住所", "住处", "回家"],
    "工作场所": ["公司", "单位", "上班", "工作", "工厂", "写字楼", "办公室"],
    "酒店": ["酒店", "宾馆", "民宿", "旅馆", "招待所"],
    "公共场所": ["广场", "公园", "景区", "景点", "超市", "农贸市场", "菜市场"],
    "学校": ["学校", "幼儿园", "小学", "中学", "大学", "培训机构"],
    "药店": ["药店", "药房", "买药"],
}

# -- fixed values: transport keyword -> code ----------------------------------
TRANSPORTS = {
    "高铁": "train_hsr",
    "火车": "train",
    "动车": "train_hsr",
    "航班": "flight",
    "飞机": "flight",
    "城轨": "light_rail",
    "地铁": "subway",
    "公交": "bus",
    "大巴": "bus",
    "客车": "bus",
    "自驾": "car",
    "私家车": "car",
    "出租车": "taxi",
    "滴滴": "taxi",
    "顺风车": "car",
}

# -- fixed values: symptoms ---------------------------------------------------
SYMPTOMS = ["发热", "咳嗽", "乏力", "咽痛", "流涕", "肺炎", "腹泻", "气短", "胸闷"]
GRAPH_SYMPTOMS = ["发热", "咳嗽", "乏力", "咽痛", "流涕", "肺炎"]
STAT_SYMPTOMS = {
    "发热": ["发热", "发烧", "体温"],
    "咳嗽": ["咳嗽"],
    "乏力": ["乏力", "疲劳", "疲倦", "无力"],
    "咽痛": ["咽痛", "喉咙痛", "嗓子疼"],
    "流涕": ["流涕", "鼻塞", "流鼻涕"],
    "肺炎": ["肺炎", "肺部"],
    "腹泻": ["腹泻", "拉肚子"],
}

# -- fixed values: flags ------------------------------------------------------
HOTSPOT_WORDS = ["武汉", "汉口", "武昌", "湖北"]
ASYMPTOMATIC_WORDS = ["无症状", "一直无异常"]

# -- fixed values: report file name suffixes ----------------------------------
REPORT_SUFFIX = "(的?确诊病例(活动轨迹|行程轨迹))$"

# -- fixed values: English labels ---------------------------------------------
VENUE_EN = {
    "医院": "Hospital",
    "餐厅": "Restaurant",
    "超市": "Supermarket",
    "交通工具": "Transportation",
    "家庭": "Household",
    "工作场所": "Workplace",
    "酒店": "Hotel",
    "公共场所": "Public Space",
    "学校": "School",
    "药店": "Pharmacy",
}
PROVINCE_EN = {
    "北京": "Beijing", "上海": "Shanghai", "天津": "Tianjin", "重庆": "Chongqing",
    "河北": "Hebei", "山西": "Shanxi", "辽宁": "Liaoning", "吉林": "Jilin",
    "黑龙江": "Heilongjiang", "江苏": "Jiangsu", "浙江": "Zhejiang", "安徽": "Anhui",
    "福建": "Fujian", "江西": "Jiangxi", "山东": "Shandong", "河南": "Henan",
    "湖北": "Hubei", "湖南": "Hunan", "广东": "Guangdong", "海南": "Hainan",
    "四川": "Sichuan", "贵州": "Guizhou", "云南": "Yunnan", "陕西": "Shaanxi",
    "甘肃": "Gansu", "青海": "Qinghai", "台湾": "Taiwan", "内蒙古": "Inner Mongolia",
    "广西": "Guangxi", "西藏": "Tibet", "宁夏": "Ningxia", "新疆": "Xinjiang",
    "香港": "Hong Kong", "澳门": "Macau",
}
