"""Categories, and the fixed word lists of the rules."""

# fixed values: category keys in rank order, their labels, and the letters of their tokens
CATEGORIES = ("organization", "person", "product", "location", "phone", "id_card", "email", "address", "custom")
LABELS = dict(zip(CATEGORIES, ("单位", "人名", "产品", "产区", "电话", "证件", "邮箱", "地址", "敏感项")))
CODES = dict(zip(CATEGORIES, "单人品区电证邮址敏"))
DEFAULT = CATEGORIES[:-1]
STATUSES = ("processing", "review", "completed", "restored", "failed", "cancelled")

# fixed values: surnames
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄"
    "和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗丁宣贲邓郁单杭洪包诸左石崔吉钮龚"
    "程嵇邢滑裴陆荣翁荀羊於惠甄曲封芮储靳汲邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘钭厉戎祖武符刘景詹束龙叶幸司韶郜黎蓟薄印宿白怀蒲邰从鄂索咸籍赖卓蔺屠蒙池乔阴胥能苍双闻莘党"
    "翟谭贡劳逄姬申扶堵冉宰郦雍郤璩桑桂濮牛寿通边扈燕冀郏浦尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庾终暨居衡步都耿满弘匡国文寇广禄阙东欧殳沃利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶空曾毋沙"
    "乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公"
)
DOUBLE_SURNAMES = (
    "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 子车 亓官 司寇 巫马 公西 颛孙 壤驷 "
    "公良 漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 段干 百里 呼延 东郭 南门"
).split()
# fixed values: words that look like names and are none
NOT_NAMES = set(
    (
        "人员 姓名 联系人 负责人 经办人 审核人 审批人 申请人 采购人 招标人 供应商 管理员 操作员 制表人 复核人 签字人 办公室 委员会 有限公司 总公司 分公司 研究院 研究所 服务中心 北京市 天津市 上海市 重庆市 "
        "合格 不合格 同意 不同意 项目 方案 申请 费用 单价 合计 金额 部门 单位 名称 规格 型号 数量 备注 日期 时间 状态 结果 意见 内容 合同 采购 招标 中标 烟草 公司 地址 手机 电话 邮箱 传真 附件 正文 标题 序号 说明 "
        "管理 支持 记录 文件 网络 系统 环境 安全 处理 完成 组长 副组长 组员 成员 主任 副主任 经理 副经理 部长 副部长 科长 副科长 处长 副处长 书记 副书记 领队 教练 裁判 评委 专家 讲师 主持人 记录人 工作人员 参赛人员 "
        "活动人员 厂领导 车间主任"
    ).split()
)
# fixed values: words before a name, labels before a list of names
ROLES = (
    "项目负责人 法定代表人 联系人 经办人 负责人 审核人 审批人 复核人 申请人 填报人 制表人 签字人 承办人 主办人 验收人 组长 副组长 主任 副主任 经理 副经理 部长 副部长 科长 副科长 处长 副处长 书记 副书记 领队 教练 裁判 评委 "
    "专家 讲师 培训师 主持人 记录人 监考人 监督员 安全员 姓名"
).split()
LIST_LABELS = (
    "参加活动人员 活动人员 参与人员 参加人员 参赛人员 培训人员 工作人员 参会人员 人员名单 人员名册 联系人名单 经办人员 审核人员 审批人员 项目成员 工作组成员 领导小组成员 筹备小组成员 小组成员 成员 组员 评审专家 专家名单 评委名单"
).split()
# fixed values: endings of organizations, provinces, places
ORG_ENDINGS = (
    "烟草专卖局 烟草公司 卷烟厂 烟叶复烤厂 复烤厂 有限责任公司 股份有限公司 集团有限公司 集团公司 总公司 分公司 有限公司 研究院 研究所 委员会 管理局 财政局 公安局 税务局 专卖局 办公室 物流中心 营销中心 技术中心 服务中心 银行 协会 学校 "
    "医院 工厂 中心 公司"
).split()
LEGAL_ENDINGS = ("有限责任公司", "股份有限公司", "集团有限公司", "有限公司", "集团公司", "公司")
FACTORY_ENDINGS = ("烟叶复烤厂", "复烤厂", "卷烟厂", "厂")
PROVINCES = (
    "北京市 天津市 上海市 重庆市 河北省 山西省 辽宁省 吉林省 黑龙江省 江苏省 浙江省 安徽省 福建省 江西省 山东省 河南省 湖北省 湖南省 广东省 海南省 四川省 贵州省 云南省 陕西省 甘肃省 青海省 台湾省 内蒙古自治区 广西壮族自治区 西藏自治区 "
    "宁夏回族自治区 新疆维吾尔自治区 香港特别行政区 澳门特别行政区"
).split()
PROVINCE_SHORTS = "北京 天津 上海 重庆 河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 海南 四川 贵州 云南 陕西 甘肃 青海 台湾 内蒙古 广西 西藏 宁夏 新疆 香港 澳门".split()
FACTORY_SHORTS = ("陆良厂", "遵义厂", "毕节厂")
INDUSTRY_SHORTS = (
    "中国烟草 山东中烟 云南中烟 贵州中烟 四川中烟 重庆中烟 湖南中烟 湖北中烟 河南中烟 安徽中烟 福建中烟 广东中烟 广西中烟 陕西中烟 甘肃烟草 江苏中烟 浙江中烟 江西中烟 河北中烟 吉林烟草 辽宁烟草 黑龙江烟草 内蒙古烟草 上海烟草 北京烟草 "
    "天津烟草"
).split()
PLACES = "云南 山东 贵州 四川 重庆 河南 湖南 湖北 福建 广东 广西 陕西 甘肃 辽宁 吉林 黑龙江 内蒙古 新疆 文山 普洱 曲靖 保山 大理 德宏 红河 玉溪 楚雄 临沧 昭通 昆明 丽江 西双版纳".split()
# fixed values: lead-ins of a list of factories, and words that are no factory's name
LEAD_INS = (
    "分别包括 分别涉及 分别为 分别是 后文统称 下文统称 服务于 分布于 先后走访 先后调研 包括 涉及 涵盖 下辖 所属 走访 调研 覆盖 委托 对接 联系 来自 位于 前往 统称 简称 根据 按照 针对 关于 依托 联合 协同 与 同 对 向 赴 由"
).split()
NOT_FACTORIES = set("我们 同时 项目 工作 研究 研发 生产 管理 技术 服务".split())
NOT_PRODUCTS = set("产品 品牌 品名 牌号 规格 型号 模块 原料 烟叶 卷烟 配方 主产品 主要产品 产品名称 品牌名称 模块名称 典型产品 典型模块组合".split())
# fixed values: long and short endings of organizations
SHORT_ENDINGS = (("烟叶复烤厂", "厂"), ("复烤厂", "厂"), ("卷烟厂", "厂"), ("烟草专卖局", "烟草局"), ("有限责任公司", "公司"), ("股份有限公司", "公司"), ("集团有限公司", "集团"), ("集团公司", "集团"), ("有限公司", "公司"))
# fixed values: prompts of a training set, and those a model is asked with at run time
PROMPTS = {"person": "人名", "organization": "单位名称", "address": "详细地址", "location": "烟叶产区", "product": "烟草品牌或产品名称"}
RUNTIME_PROMPTS = PROMPTS | {"organization": "单位名称 部门名称"}
