"""The literal detection cases."""

import pytest

from maskwright.functions.mapping import Mapping, restore, thresholded

CASES = [
    ("单位：中国烟草总公司\n联系人：张三\n电话：13800138000", None, {"单位": 1, "人名": 1, "电话": 1}),
    ("云南中烟工业有限责任公司与红云红河烟草（集团）有限责任公司签订采购合同，项目负责人王建国，李娜负责复核，送货至云南省昆明市五华区红锦路123号，联系电话0871-63568888。", None, {"单位": 2, "人名": 2, "地址": 1, "电话": 1}),
    ("人员名单：张三、李四、王五\n\n欧阳娜\n部门：财务部", None, {"人名": 4, "单位": 1}),
    ("组长：潘富昆。负责整个技能竞赛的宏观指导与活动协调。\n成员：赵英桥、李作英。负责跟进各项活动的具体实施。\n参加活动人员：厂领导、【单002】及生产加工车间参赛人员。", ("person",), {"人名": 3}),
    ("陆良厂与云南复烤、贵州复烤、河北中烟联合开展技术研究。", ("organization",), {"单位": 4}),
    ("陆良、泸西、石林厂联合开展技术改造。", ("organization",), {"单位": 3}),
    ("公司先后走访陆良、泸西、石林等3家复烤厂，毕节、曲靖两厂同时参与。", ("organization",), {"单位": 5}),
    ("陆良复烤厂、泸西复烤厂、石林复烤厂联合开展工作。", ("organization",), {"单位": 3}),
    ("山东中烟在文山产区生产品牌：文山雨露。", None, {"单位": 1, "产区": 1, "产品": 1}),
    ("单 位：中 国 烟 草 总 公 司\n联 系 人：张 三\n138 0013 8000", None, {"单位": 1, "人名": 1, "电话": 1}),
    ("审核状态：合格\n审批意见：同意\n项目\n方案\n申请\n费用\n单价\n说明\n文件\n安全\n管理", ("person",), {}),
]


@pytest.mark.parametrize("text, enabled, counts", CASES)
def test_counts_and_round_trip(text, enabled, counts):
    m = Mapping(enabled) if enabled else Mapping()
    m.discover(text)
    assert m.counts() == counts
    assert restore(m.mask(text), m.export()) == text


def test_series_keeps_its_frame():
    m = Mapping(("organization",))
    text = CASES[6][0]
    m.discover(text)
    assert "等3家复烤厂" in m.mask(text) and "两厂同时参与" in m.mask(text)


def test_clause_before_a_company():
    m = Mapping(("organization",))
    m.discover("遵义复烤厂中心实验室为贵州烟叶复烤有限责任公司中心实验室。")
    assert "贵州烟叶复烤有限责任公司" in m.entries


def test_spelling_variants_share_a_token():
    m = Mapping(("organization",), custom=[("陆良复烤厂", "organization")], namespace="LOCAL88")
    out = m.mask("甲方为陆良复烤厂；复核仍由陆​良 复 烤 厂负责，其他句子保持不变。")
    assert out == "甲方为【LOCAL88-单001】；复核仍由【LOCAL88-单001】负责，其他句子保持不变。"


def test_merge_restores_to_the_canonical_name():
    m = Mapping(("organization",))
    m.register("陆良复烤厂", "organization")
    m.register("陆良厂", "organization")
    m.merge("陆良复烤厂", ["陆良厂"])
    out = m.mask("陆良复烤厂安排陆良厂复核。")
    assert m.counts() == {"单位": 1} and restore(out, m.export()) == "陆良复烤厂安排陆良复烤厂复核。"


def test_numbers_are_not_given_twice():
    m = Mapping(("organization",))
    for x in ("甲单位", "乙单位", "丙单位"):
        m.register(x, "organization")
    m.merge("甲单位", ["乙单位"])
    assert m.register("丁单位", "organization") not in (m.entries["丙单位"], m.entries["甲单位"])


def test_tokens_survive_reprocessing():
    one = Mapping(("organization",))
    one.register("甲单位", "organization")
    token = one.register("乙单位", "organization")
    old = one.mask("甲单位和乙单位")
    two = Mapping(("organization",), previous=one.export())
    assert two.register("乙单位", "organization") == token
    assert two.register("丙单位", "organization") not in (token, one.entries["甲单位"])
    assert restore(old, two.export()) == "甲单位和乙单位"


def test_alias_suggestions():
    m = Mapping(("organization",))
    text = "云南烟叶复烤有限责任公司简称云南复烤；贵州烟叶复烤有限责任公司简称贵州复烤；河北中烟工业有限责任公司简称河北中烟；陆良复烤厂后文简称陆良厂。"
    m.discover(text)
    pairs = {tuple(g["members"]) for g in m.suggest(text)}
    assert {("云南烟叶复烤有限责任公司", "云南复烤"), ("贵州烟叶复烤有限责任公司", "贵州复烤"), ("河北中烟工业有限责任公司", "河北中烟"), ("陆良复烤厂", "陆良厂")} <= pairs


def test_series_suggestions():
    m = Mapping(("organization",))
    text = "陆良复烤厂、泸西复烤厂、石林复烤厂完成改造，后文统称陆良、泸西、石林三厂。"
    m.discover(text)
    found = [g for g in m.suggest(text) if "顿号并列" in g["reason"]]
    assert {tuple(g["members"]) for g in found} == {("陆良复烤厂", "陆良"), ("泸西复烤厂", "泸西"), ("石林复烤厂", "石林")}


def test_file_names():
    m = Mapping(("person",))
    m.discover_stem("潘富昆技能竞赛活动方案")
    out = m.mask("潘富昆技能竞赛活动方案", filename=True)
    assert "ANON_人001" in out and restore(out, m.export()) == "潘富昆技能竞赛活动方案"


def test_model_candidates():
    found = [("文山雨露", "person", 0.99), ("文山雨露", "product", 0.82), ("云南省", "person", 0.99), ("云南省", "location", 0.80), ("山东中烟", "organization", 0.40)]
    kept, rejected = thresholded([{"text": t, "category": c, "probability": p} for t, c, p in found], {"person": 0.70, "organization": 0.55, "product": 0.60, "location": 0.60, "address": 0.60})
    assert kept == [("文山雨露", "product"), ("云南省", "location")] and rejected == 3
