"""Extraction patterns of the default vocabulary (vehicle body control): what a text mentions and how it relates things."""

from __future__ import annotations

# The patterns on which extraction results depend. (?U) gives word signs and boundaries their Unicode meaning.
SIGNAL = r"(?U)\b([A-Z][A-Za-z0-9_]{3,}(?:Sts|Mode|Status|SW|Cmd|Req|Relay|Signal|Msg|Active|Enable|Disable|Request|State|Value|Cnt|Cntrl)?)\b"
STATE = r"(?U)\b(Inactive|Active|Driving|Convenience|Abandoned|Disarmed|Armed|PreArmed|Alarm|Wakeup|Sleep|Standby|OFF|ACC|ON|Idle|Run|Crank|Charging|Discharging)\b"
STATE_CN = r"(?U)(\w{2,20})\s*(?:状态|模式)\b"
PARAMETER = r"(?U)\b(Cfg|cfg|Cal|cal|NVM_|nvm_)[A-Za-z0-9_]+\b"
CAN_ID = r"(?U)\b(0x[0-9A-Fa-f]{3,8})\b"
CAN_MESSAGE = r"(?U)\b(?:CAN\s*(?:报文|消息|信号|Message|Frame|ID)\s*[:：]?\s*)?((?:BCM|VCU|PEPS|ESC|TCM|ABS|EMS|IC|GW|BMS)_[A-Za-z0-9_]{3,})\b"
PIN = r"(?U)\b(PIN\s*\d{1,3}|Pin\s*\d{1,3}|pin\s*\d{1,3}|KL30|KL15|KL31|KL87|GND|VBAT|(?:HSD|LSD|H-Bridge|Relay)\s*\d*)\b"
FUNCTION_TITLE = "功能描述|功能说明|激活逻辑|关闭逻辑|使能条件|关闭条件|控制逻辑"
FUNCTION_TEXT = (
    r"(GlobalClose|AutoLock|CrashUnlock|FollowMeHome|WelcomeLight|ComingHome|LeavingHome|CorneringLight|AutoFold|AutoFoldBack|GlobalOpen|KeyReminder"
    r"|[一-鿿]{2,15}(?:功能|控制|管理|保护|检测|诊断))"
)
#: Names that the signal pattern finds and that are none.
NO_SIGNALS = ("NULL", "True", "False")

#: What a paragraph or list mentions: (entity type, pattern, group of the name, least length). Of several types for a name the first counts.
MENTIONS = (
    ("signal", SIGNAL, 1, 4),
    ("parameter", PARAMETER, 0, 1),
    ("state", STATE, 0, 1),
    ("state", STATE_CN, 1, 2),
    ("can_message", CAN_MESSAGE, 1, 1),
    ("can_message", CAN_ID, 0, 1),
    ("hardware_pin", PIN, 0, 1),
    ("function", FUNCTION_TEXT, 0, 3),
)

#: How a text relates things: (relation, pattern, source, target). An end is (what, group, entity type or ""): what is "name" (of that
#: type, or of the type that the name has or looks like), "state", "function" or "module" (those of the item's section), "section" (the
#: item's), "number" (of a section), or "foreign" (a name within the module of the group after it).
RELATIONS = (
    ("transition_to", r"(?U)迁移到\s*(\w+)\s*状态", ("state", 0, ""), ("name", 1, "state")),
    ("outputs", r"(?U)发送\s*(?:CAN)?\s*信号\s*(\w+)\s*=\s*(0x[0-9A-Fa-f]+)\s*:?\s*(\w+)?", ("name", 3, "state"), ("name", 1, "signal")),
    (
        "triggered_by",
        r"(?U)(?:当|一旦|若|如果)\s*(\w{3,30})\s*(?:==?|≠|不等于?|大于|小于|变为?|切换到?|设置为?)\s*(\w{0,20})\s*"
        r"(?:时|后|之际|时，|时。|则|,)\s*(?:触发|激活|唤醒|启动|进入|退出|执行)(?=[\s\S]*?(?:触发|激活|唤醒|启动|进入|执行)\s*(\w{3,30}))",
        ("name", 3, ""),
        ("name", 1, "signal"),
    ),
    ("triggered_by", r"(?U)(\w+)\s*(?:的)?\s*(?:上升沿|下降沿|边沿|变化)\s*(?:触发|激活)\s*(\w+)", ("name", 2, "function"), ("name", 1, "signal")),
    ("triggered_by", r"(?U)(?:触发条件|触发源|唤醒源|激活条件)[：:]\s*(\w{3,30})", ("function", 0, ""), ("name", 1, "signal")),
    ("depends_on", r"(?U)(\w{3,30})\s*(?:依赖于|依赖|取决于|取决于信号|的前提是|的前置条件是|必要条件)\s*(\w{3,30})", ("name", 1, ""), ("name", 2, "")),
    ("depends_on", r"(?U)(?:需要|要求|前提)\s*(\w+)\s*(?:处于|为|=)\s*(\w+)\s*(?:状态|模式)?\s*(?:才能|方可|可以|允许)", ("name", 1, "signal"), ("name", 2, "state")),
    ("controls", r"(?U)(\w{2,30})\s*(?:控制|管控(?:逻辑)?|管理)\s*(\w{2,30})\s*(?:的)?\s*(?:输出|功能|状态|电源|继电器)", ("name", 1, ""), ("name", 2, "")),
    ("controls", r"(?U)(\w{2,30})\s*(?:使能|启用|禁用|关闭|打开)\s*(\w{2,30})", ("name", 1, ""), ("name", 2, "")),
    ("requires", r"(?U)(?:需要|要求|必须有|必须存在|必要条件)[：:]?\s*(\w{3,30})\s*(?:信号|状态|报文|配置)?", ("function", 0, ""), ("name", 1, "")),
    ("configures", r"(?U)(\w{3,30})\s*(?:配置|标定|设置|参数)\s*(?:了|为|成)?\s*(\w{2,30})\s*(?:的)?\s*(?:功能|参数|值|选项|阈值|时间)", ("name", 1, ""), ("name", 2, "")),
    ("configures", r"(?U)(?:通过|使用|利用|经由)\s*(\w{3,30})\s*(?:配置|标定|设置)\s*(\w{2,30})", ("name", 1, ""), ("name", 2, "")),
    ("reports", r"(?U)(\w{2,30})\s*(?:上报|报告|反馈|通知)\s*(\w{2,30})\s*(?:故障|状态|事件|信号|DTC|报警)?", ("name", 1, ""), ("name", 2, "")),
    ("reports", r"(?U)(?:DTC|诊断(?:码)?|故障码)[：:]?\s*(\w{3,20})\s*(?:上报|报告|反馈)", ("function", 0, ""), ("name", 1, "fault")),
    ("references", r"(?:参见|参考|详见|参照|见|参阅)\s*(?:第\s*)?(\d+(?:\.\d+)*)\s*(?:节|章|页|段|部分)?", ("section", 0, ""), ("number", 1, "")),
    ("references", r"(?:如|按照|根据|参考)\s*(?:第\s*)?(\d+(?:\.\d+)*)\s*(?:节|章)\s*(?:所述|的定义|的规定|的描述)", ("section", 0, ""), ("number", 1, "")),
    ("references", r"(?U)(VMM|ExteriorLight|InteriorLight|Window|Lock|TheftProtection|Wiper|RemoteControl)\s*(?:模块|的)\s*(\w{3,30})", ("module", 0, ""), ("foreign", 2, "")),
)

#: Words of which a text must hold one for a pattern to be found in it: finding them costs a fraction of trying the pattern at every sign.
CUES = {
    STATE: ("Active", "Inactive", "Driving", "Convenience", "Abandoned", "rmed", "Alarm", "Wakeup", "Sleep", "Standby", "OFF", "ACC", "ON", "Idle", "Run", "Crank", "harging"),
    STATE_CN: ("状态", "模式"),
    PARAMETER: ("Cfg", "cfg", "Cal", "cal", "NVM_", "nvm_"),
    CAN_ID: ("0x",),
    CAN_MESSAGE: ("BCM_", "VCU_", "PEPS_", "ESC_", "TCM_", "ABS_", "EMS_", "IC_", "GW_", "BMS_"),
    PIN: ("PIN", "Pin", "pin", "KL", "GND", "VBAT", "HSD", "LSD", "H-Bridge", "Relay"),
    FUNCTION_TEXT: (
        "GlobalClose", "AutoLock", "CrashUnlock", "FollowMeHome", "WelcomeLight", "ComingHome", "LeavingHome", "CorneringLight", "AutoFold", "GlobalOpen", "KeyReminder",
        "功能", "控制", "管理", "保护", "检测", "诊断",
    ),
    **dict(
        zip(
            (r[1] for r in RELATIONS),
            (
                ("迁移到",), ("信号",), ("当", "一旦", "若", "如果"), ("沿", "变化"), ("触发条件", "触发源", "唤醒源", "激活条件"),
                ("依赖", "取决于", "的前提是", "的前置条件是", "必要条件"), ("才能", "方可", "可以", "允许"), ("控制", "管控", "管理"), ("使能", "启用", "禁用", "关闭", "打开"),
                ("需要", "要求", "必须有", "必须存在", "必要条件"), ("配置", "标定", "设置", "参数"), ("通过", "使用", "利用", "经由"), ("上报", "报告", "反馈", "通知"), ("上报", "报告", "反馈"),
                ("见", "参考", "参照", "参阅"), ("所述", "的定义", "的规定", "的描述"), ("VMM", "ExteriorLight", "InteriorLight", "Window", "Lock", "TheftProtection", "Wiper", "RemoteControl"),
            ),
            strict=True,
        )
    ),
}

#: The entity type that a record of each table class names.
RECORD_TYPES = {
    "signal_def": "signal", "can_signal": "can_message", "state_machine": "state", "config_param": "parameter", "output_pin": "hardware_pin",
    "fault_diag": "fault", "transition": "state", "function_list": "function", "voltage_range": "parameter",
}
#: Driver types that an output pin may name, and where a trigger's text says which state is entered.
DRIVERS = ("HSD", "LSD", "H-Bridge", "Relay")
SECTION_STATE = r"(?U)(\w+)\s*(?:状态|模式|State|Mode)"
ENTERED = r"(?U)(?:进入|迁移到|切换到|变为?|切换到?|进入)\s*(\w+)\s*(?:状态|模式)?"
ENTERED_BY_PEER = r"(?U)(?:进入|切换到|变为?)\s*(\w+)\s*(?:状态|模式)?"
